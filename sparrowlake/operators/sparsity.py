"""Matrix sparsity, inequality and concentration of an interaction log.

Inequality measures need the counts in ascending order. A global window would put
every entity into one task, so they work on the histogram (count -> entities), whose
size is the number of different counts, not the number of entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entity_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per value of ``key`` (null keys are left out): key, n."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def count_histogram(counts: DataFrame) -> DataFrame:
    """How many entities have each count: n, entities."""
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("entities"))


def gini(counts: DataFrame) -> DataFrame:
    """Gini coefficient of ``counts.n``: 2*sum(i*y)/(n*sum(y)) - (n+1)/n over ascending y; one row: items, total, gini."""
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = count_histogram(counts).withColumn("upto", F.sum("entities").over(w))
    # the ranks of the entities that share a count are upto-entities+1 .. upto
    ranks = F.col("entities") * (F.col("upto") * 2 - F.col("entities") + 1) / 2
    return (
        h.agg(F.sum("entities").alias("items"), F.sum(F.col("n") * F.col("entities")).alias("total"), F.sum(ranks * F.col("n")).alias("weighted"))
        .select(
            F.coalesce("items", F.lit(0)).alias("items"),
            F.coalesce("total", F.lit(0)).alias("total"),
            (F.lit(2.0) * F.col("weighted") / (F.col("items").cast("double") * F.col("total")) - (F.col("items") + 1).cast("double") / F.col("items")).alias("gini"),
        )
    )


def matrix_profile(log: DataFrame, user: str, item: str) -> DataFrame:
    """One row: interactions, users, items, sparsity (6 decimals), gini of item popularity (4 decimals)."""
    users = entity_counts(log, user).agg(F.count(F.lit(1)).alias("users"))
    g = gini(entity_counts(log, item))
    return g.crossJoin(F.broadcast(users)).select(
        F.col("total").cast("bigint").alias("interactions"),
        "users",
        F.col("items").cast("bigint").alias("items"),
        F.round(1 - F.col("total").cast("double") / (F.col("users").cast("double") * F.col("items")), 6).alias("sparsity"),
        F.round("gini", 4).alias("gini"),
    )
