"""Missing values: rates, co-missing pairs, gaps between labels. One aggregation over the table each."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN in a floating column."""
    null = F.col(c).isNull()
    return null | F.isnan(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else null


def _share(df: DataFrame, c: str) -> Column:
    return F.avg(is_missing(df, c).cast("double"))


def _long(one_row: DataFrame, names: list[str], keys: list[str] = [], value: str = "value") -> DataFrame:  # noqa: B006
    """A row a name from one wide row (or one a key), without another pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias(value)) for n in names)))
    return one_row.select(*keys, pairs.alias("_p")).select(*keys, "_p.*")


def null_rates(df: DataFrame) -> DataFrame:
    """column_name, null_rate, coverage (1 - the rounded rate); 4 decimals."""
    wide = df.agg(*(F.round(_share(df, c), 4).alias(c) for c in df.columns))
    return _long(wide, df.columns, value="null_rate").withColumn("coverage", F.round(1 - F.col("null_rate"), 4))


def overall(df: DataFrame) -> DataFrame:
    """One row: rows, cells, nulls, overall_rate."""
    nulls = sum((F.sum(is_missing(df, c).cast("bigint")) for c in df.columns[1:]), F.sum(is_missing(df, df.columns[0]).cast("bigint")))
    x = df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(nulls, F.lit(0)).alias("nulls"))
    cells = F.col("row_count") * len(df.columns)
    return x.select("row_count", cells.alias("cells"), "nulls", F.round(F.try_divide(F.col("nulls").cast("double"), cells), 4).alias("overall_rate"))


def co_missing(df: DataFrame, top: int = 10) -> DataFrame:
    """The pairs of columns most often missing together, of columns whose rounded rate lies between 0.05 and 0.95."""
    if len(df.columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, rate double")
    rates = [F.round(_share(df, c), 4).alias(c) for c in df.columns]
    both = [F.round(F.avg((is_missing(df, a) & is_missing(df, b)).cast("double")), 4).alias(f"{a}|{b}") for a, b in combinations(df.columns, 2)]
    wide = df.agg(*rates, *both)
    open_ = lambda c: (F.col(c) > 0.05) & (F.col(c) < 0.95)
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.when(open_(a) & open_(b), F.col(f"`{a}|{b}`")).alias("rate")) for a, b in combinations(df.columns, 2))))
    return wide.select(pairs.alias("p")).select("p.*").where("rate > 0").orderBy(F.desc("rate"), "column_a", "column_b").limit(top)


def null_rate_by_label(df: DataFrame, label: str) -> DataFrame:
    """label, column_name, null_rate; rows without a label are left out."""
    names = [c for c in df.columns if c != label]
    wide = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(*(F.round(_share(df, c), 4).alias(c) for c in names))
    return _long(wide, names, ["label"], "null_rate")


def label_gap(df: DataFrame, label: str, least: float = 0.05, top: int = 15) -> DataFrame:
    """column_name and the largest difference of its (rounded) null rate between two labels, if at least ``least``."""
    rates = null_rate_by_label(df, label).groupBy("column_name").agg(F.max("null_rate").alias("hi"), F.min("null_rate").alias("lo"))
    return rates.select("column_name", F.round(F.col("hi") - F.col("lo"), 4).alias("gap")).where(F.col("gap") >= least).orderBy(F.desc("gap"), "column_name").limit(top)


def suspected_embeddings(df: DataFrame, columns: list[str], rate: float = 0.8, distinct: int = 10) -> DataFrame:
    """Columns with a null rate over ``rate`` and more than ``distinct`` different values."""
    wide = df.agg(*(F.struct(_share(df, c).alias("r"), F.countDistinct(c).alias("d")).alias(c) for c in columns))
    x = _long(wide, columns)
    return x.where((F.col("value.r") > rate) & (F.col("value.d") > distinct)).select("column_name", F.round("value.r", 4).alias("null_rate"), F.col("value.d").alias("distinct_values"))
