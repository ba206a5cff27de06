"""Feature encoders: fit gives a small table, transform is a left join on it with a default."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowlake.functions.columns import log1p_norm, minmax, zscore


def fit_frequency(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("frequency"))


def fit_target(df: DataFrame, c: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """c, encoded: (n * mean + smoothing * global) / (n + smoothing)."""
    overall = df.agg(F.avg(F.col(target).cast("double")).alias("_g"))
    per = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(target).alias("_n"), F.sum(F.col(target).cast("double")).alias("_s"))
    return per.crossJoin(F.broadcast(overall)).select(c, ((F.coalesce("_s", F.lit(0.0)) + smoothing * F.col("_g")) / (F.col("_n") + smoothing)).alias("encoded"), F.col("_g").alias("overall"))


def fit_vocabulary(df: DataFrame, c: str, top: int = 500_000) -> DataFrame:
    """c, code from 1 by frequency, then value; at most ``top`` codes, the rest is unknown (0)."""
    head = fit_frequency(df, c).orderBy(F.desc("frequency"), c).limit(top)
    return head.withColumn("code", F.row_number().over(Window.orderBy(F.desc("frequency"), c)).cast("bigint"))  # at most ``top`` rows


def apply_code(df: DataFrame, fitted: DataFrame, c: str, value: str, default: object = 0) -> DataFrame:
    """``df`` with ``value`` looked up by ``c``; values that were not seen get the default."""
    return df.join(fitted.select(c, value), c, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def numeric_fit(df: DataFrame, c: str) -> DataFrame:
    x = F.col(c).cast("double")
    std = F.sqrt(F.abs(F.avg(x * x) - F.avg(x) * F.avg(x)))
    return df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("_mean"), std.alias("_std"))


def normalize(df: DataFrame, c: str, how: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``c`` by 'minmax', 'zscore' or 'log1p'."""
    if how == "log1p":
        return df.withColumn(name, log1p_norm(F.col(c)))
    x = df.crossJoin(F.broadcast(numeric_fit(df, c)))  # one row
    value = minmax(F.col(c).cast("double"), F.col("_lo"), F.col("_hi")) if how == "minmax" else zscore(F.col(c).cast("double"), F.col("_mean"), F.col("_std"))
    return x.withColumn(name, value).drop("_lo", "_hi", "_mean", "_std")
