"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from sparrowlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return int(x) if isinstance(x, (np.integer, np.bool_)) else x


def rows(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY.oracles))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.REGISTRY.queries[name](spark, SF).toPandas()
    want = duck.execute(catalog.REGISTRY.oracles[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.REGISTRY.queries) - set(catalog.REGISTRY.oracles)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.REGISTRY.queries[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
