"""Sources, sinks and generators as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sparrowlake.plans.catalog import REGISTRY
from sparrowlake.plans.registry import table
from sparrowlake.sources import tables
from sparrowlake.streaming.jobs import work_dir

query = REGISTRY.query
_PAIRS = [(f, c) for f, cs in tables.CODECS.items() for c in cs]


@query("format_round_trips", " UNION ALL ".join(f"SELECT '{f}' AS fmt, '{c}' AS codec, count(*)::BIGINT AS row_count, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM orders" for f, c in _PAIRS))
def format_round_trips(spark, sf_dir):
    """Orders written and read again in each format and codec."""
    orders, base, out = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), work_dir(spark), []
    for f, c in _PAIRS:
        path = f"{base}/{c}.{f}"
        tables.materialize(orders, path, f, c, sort_by=["o_orderkey"])
        out.append(tables.load(spark, path).agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(f).alias("fmt"), F.lit(c).alias("codec"), "row_count", "keys", "total"))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("partitioned_layout", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def partitioned_layout(spark, sf_dir):
    """A table in folders by status: the filter reads only the folders it needs."""
    path = f"{work_dir(spark)}/orders.parquet"
    tables.materialize(table(spark, sf_dir, "orders"), path, partition_by=["o_orderstatus"], sort_by=["o_orderkey"], codec="zstd")
    return tables.load(spark, path).where("o_orderstatus <> 'F'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("downcast", "SELECT 'l_linenumber' AS column_name, 'tinyint' AS kind UNION ALL SELECT 'l_quantity', 'float' UNION ALL SELECT 'l_returnflag', 'category' UNION ALL SELECT 'l_suppkey', CASE WHEN max(l_suppkey) < 128 THEN 'tinyint' WHEN max(l_suppkey) < 32768 THEN 'smallint' ELSE 'int' END FROM lineitem")
def downcast(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_returnflag", "l_suppkey")
    plan = tables.downcast_plan(x)
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(v) for kv in plan.items() for v in kv])).alias("column_name", "kind"))


def _hash(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT"


@query("synthetic_pairs", f"""WITH d AS (SELECT r AS draw, ({_hash("'42'", "'user_id'", 'r::VARCHAR')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS a, ({_hash("'42'", "'item_id'", 'r::VARCHAR')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS b FROM range(0, 5000) v(r)),
u AS (SELECT r AS user_id, sum(pow(r::DOUBLE, -0.75)) OVER (ORDER BY r) / (SELECT sum(pow(q::DOUBLE, -0.75)) FROM range(1, 201) w(q)) AS hi, pow(r::DOUBLE, -0.75) / (SELECT sum(pow(q::DOUBLE, -0.75)) FROM range(1, 201) w(q)) AS w FROM range(1, 201) v(r)),
i AS (SELECT r AS item_id, sum(pow(r::DOUBLE, -0.75)) OVER (ORDER BY r) / (SELECT sum(pow(q::DOUBLE, -0.75)) FROM range(1, 301) w(q)) AS hi, pow(r::DOUBLE, -0.75) / (SELECT sum(pow(q::DOUBLE, -0.75)) FROM range(1, 301) w(q)) AS w FROM range(1, 301) v(r))
SELECT DISTINCT user_id, item_id, 1 AS label FROM d JOIN u ON a >= u.hi - u.w AND a < u.hi JOIN i ON b >= i.hi - i.w AND b < i.hi""")
def synthetic_pairs(spark, sf_dir):
    return tables.synthetic(spark, 200, 300, 5000)


@query("benchmark_rows", f"SELECT {_hash(chr(39) + '42' + chr(39), chr(39) + 'user' + chr(39), 'r::VARCHAR')} % 1000 AS user_id, 'cat_' || ({_hash(chr(39) + '42' + chr(39), chr(39) + 'f0' + chr(39), 'r::VARCHAR')} % 100) AS feat_cat_0, ({_hash(chr(39) + '42' + chr(39), chr(39) + 'f2' + chr(39), 'r::VARCHAR')} % 1000)::INTEGER AS feat_int_2 FROM range(0, 10000) v(r)")
def benchmark_rows(spark, sf_dir):
    return tables.benchmark_rows(spark, 10_000).select("user_id", "feat_cat_0", "feat_int_2")
