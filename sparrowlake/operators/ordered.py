"""Global order without a global task.

A rank or running sum over a whole table needs a total order, but not one task: rows
are dealt to buckets that respect the order (a day, the leading digits of a hash, the
leading digits of a number), each bucket is ordered by itself, and the totals of the
buckets before it are added. Only the buckets' totals meet in one place: a row a bucket,
and there are 2^14 buckets of a hash, and 4096 (of ids: 256) for each power of two that a
column's numbers span, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers within 1 / STEPS of each other's binary logarithm may share a bucket; ids, which lie further apart, take fewer steps.
STEPS, ID_STEPS = 4096, 256


def _offsets(buckets: DataFrame, totals: list[str], descending: bool, keys: list[str]) -> DataFrame:
    order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select(*keys, "_bucket", *(F.coalesce(F.sum(t).over(w), F.lit(0)).alias(f"_before_{t}") for t in totals))


def ranked(df: DataFrame, bucket: Column, order: list[Column], name: str = "rank", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with the 1-based position of each row in the order, within ``keys``; ``bucket`` is never null and never falls along the order, keys are not null."""
    x = df.withColumn("_bucket", bucket)
    offsets = _offsets(x.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n")), ["n"], False, keys)
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    # a row a bucket (and key): Spark broadcasts it if its measured size is small
    return x.withColumn("_place", place).join(offsets, [*keys, "_bucket"]).withColumn(name, (F.col("_before_n") + F.col("_place")).cast("bigint")).drop("_bucket", "_place", "_before_n")


def running(df: DataFrame, bucket: Column, order: list[Column], sums: list[str], descending: bool = False, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with ``cum_<column>`` for each of ``sums``, within ``keys``: the sum up to and including the row. ``descending``: the order runs from high buckets to low."""
    x = df.withColumn("_bucket", bucket)
    offsets = _offsets(x.groupBy(*keys, "_bucket").agg(*(F.sum(s).alias(s) for s in sums)), sums, descending, keys)
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({f"_in_{s}": F.sum(s).over(w) for s in sums})
    x = x.join(offsets, [*keys, "_bucket"])
    return x.withColumns({f"cum_{s}": F.col(f"_before_{s}") + F.col(f"_in_{s}") for s in sums}).drop("_bucket", *(f"_in_{s}" for s in sums), *(f"_before_{s}" for s in sums))


def following(df: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """``df`` (distinct numbers ``value``) with ``next_<column>``: the columns of the row with the next smaller number, null at the end."""
    x = df.withColumn("_bucket", number_bucket(F.col(value)))
    here = F.struct(*columns)
    heads = x.groupBy("_bucket").agg(F.max_by(here, value).alias("_head"))  # a row a bucket
    after = heads.select("_bucket", F.lead("_head").over(Window.orderBy(F.desc("_bucket"))).alias("_after"))
    inside = F.lead(here).over(Window.partitionBy("_bucket").orderBy(F.desc(value)))
    joined = x.withColumn("_next", inside).join(after, "_bucket").withColumn("_next", F.coalesce("_next", "_after"))
    return joined.withColumns({f"next_{c}": F.col("_next")[c] for c in columns}).drop("_bucket", "_next", "_after")


def hash_bucket(word: Column, bits: int = 14) -> Column:
    """The leading bits of a 32-bit hash: buckets that follow the hash's order."""
    return F.shiftright(word, 32 - bits)


def number_bucket(number: Column, steps: int = STEPS) -> Column:
    """Buckets (``steps`` for each power of two) that follow a number's order, as null, -inf .. inf, NaN: sign and leading digits of the logarithm."""
    x = number.cast("double")
    size = F.floor(F.least(F.log2(F.abs(x)) * steps, F.lit(5e6))) + 6_000_000  # 1075 powers of two below 1, 1024 above
    signed = F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("bigint"))
    return F.when(x.isNull(), F.lit(-20_000_000).cast("bigint")).when(F.isnan(x), F.lit(20_000_000).cast("bigint")).otherwise(signed)
