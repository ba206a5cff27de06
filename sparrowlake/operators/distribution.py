"""Distributions: label shares, cardinalities, dense statistics, per-feature AUC, column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlake.operators.missing import _long
from sparrowlake.operators.ordered import number_bucket, running

BIN_LABELS = ["1-10", "11-100", "101-1K", "1K-10K", "10K-100K", "100K+"]


def shares(df: DataFrame, c: str, name: str = "value") -> DataFrame:
    """Each value (nulls left out), its rows and its share (4 decimals)."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(name, "n", F.round(F.col("n").cast("double") / F.col("total"), 4).alias("share"))


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, distinct_values (nulls not counted). Arrays and structs count as values."""
    # a row for each (column, value) is pre-aggregated before the shuffle, so many columns cost one exchange
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.to_json(F.struct(F.col(c).alias("v"))).alias("j"), F.col(c).isNotNull().alias("ok")) for c in columns))).alias("p")).select("p.*")
    found = pairs.groupBy("c", "j", "ok").agg(F.lit(1).alias("one")).groupBy("c").agg(F.sum(F.col("ok").cast("bigint")).alias("distinct_values"))
    return found.select(F.col("c").alias("column_name"), "distinct_values")


def cardinality_bins(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many columns fall into each bin of cardinality; empty columns into none."""
    d = F.col("distinct_values")
    label = F.when(d <= 10, BIN_LABELS[0]).when(d <= 100, BIN_LABELS[1]).when(d <= 1000, BIN_LABELS[2]).when(d <= 10_000, BIN_LABELS[3]).when(d <= 100_000, BIN_LABELS[4]).otherwise(BIN_LABELS[5])
    return cardinality(df, columns).where(d > 0).groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("columns"))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness, 0 with fewer than three values or no spread."""
    n = F.count(x).cast("double")
    return F.when((n < 3) | (F.coalesce(F.var_pop(x), F.lit(0.0)) == 0), F.lit(0.0)).otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def dense_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, mean, std (sample), min, max, skew, zero_rate (of all rows); 4 decimals."""
    def of(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(
            F.round(F.avg(x), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 4).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.round(sample_skewness(x), 4).alias("skew"), F.round(F.sum((x == 0).cast("bigint")).cast("double") / F.count(F.lit(1)), 4).alias("zero_rate"),
        ).alias(c)

    return _long(df.agg(*(of(c) for c in columns)), columns).select("column_name", "value.*")


def rank_auc(scores: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Rank-sum AUC with averaged ties of (keys, y in 0/1, score): auc is null without both classes.

    Rows are first counted by score, and the scores are ordered by buckets that follow them.
    Keys are not null.
    """
    h = scores.groupBy(*keys, "score").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    cum = running(h, number_bucket(F.col("score")), [F.col("score")], ["neg"], keys=keys)
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return cum.groupBy(*keys).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def feature_auc(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """column_name, auc (4 decimals), reason: median-imputed single-feature AUC against a 0/1 label; a reason where it is skipped."""
    rows = df.where(F.col(label).isNotNull())
    medians = rows.agg(*(F.struct(F.median(F.col(c).cast("double")).alias("m"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")).alias(c) for c in features))
    stats = _long(medians, features).select("column_name", F.col("value.m").alias("m"), F.when(F.col("value.m").isNull(), "all_null").when(F.col("value.lo") == F.col("value.hi"), "constant").alias("reason"))
    long = rows.select(F.col(label).cast("int").alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in features))).alias("f")).select("y", "f.*")
    usable = long.join(F.broadcast(stats.where("reason IS NULL")), "column_name").select("column_name", "y", F.coalesce("x", "m").alias("score"))
    auc = rank_auc(usable, ["column_name"])
    return stats.join(auc, "column_name", "left").select("column_name", F.round("auc", 4).alias("auc"), "reason")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, distinct_values, nulls, min, max, mean, std (sample) of numeric columns."""
    wide = df.agg(*(F.struct(F.countDistinct(c).alias("distinct_values"), F.sum(F.col(c).isNull().cast("bigint")).alias("nulls"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.round(F.avg(F.col(c).cast("double")), 4).alias("mean"), F.round(F.stddev_samp(F.col(c).cast("double")), 4).alias("std")).alias(c) for c in columns))
    return _long(wide, columns).select("column_name", "value.*")


def top_values(df: DataFrame, c: str, top: int = 1000) -> DataFrame:
    """The ``top`` most frequent values and their counts: a report, so the limit is the feature."""
    return df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
