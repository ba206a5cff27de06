"""Ranking metrics of groups: rows (group_id, candidate_id, score, relevance), best score first, ties to the smaller candidate.

A group without a relevant candidate has no metrics; a cut-off beyond a group's
candidates is missing for it. The means run over the groups that have the metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """Rows with rank, hits (relevant ones up to here), n (candidates) and total (relevant ones: of the group, or of ``relevant`` (group_id, total))."""
    order = Window.partitionBy("group_id").orderBy(F.desc("score"), "candidate_id")
    whole = Window.partitionBy("group_id")
    hit = (F.col("relevance") > 0).cast("int")
    x = df.select("*", F.row_number().over(order).alias("rank"), F.sum(hit).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"), F.count(F.lit(1)).over(whole).alias("n"), hit.alias("hit"))
    if relevant is None:
        return x.withColumn("total", F.sum("hit").over(whole))
    return x.join(relevant.select("group_id", "total"), "group_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def _ideal(total: Column, k: int) -> Column:
    """DCG of a ranking whose first min(total, k) candidates are relevant."""
    steps = [0.0]
    import math

    for i in range(1, k + 1):
        steps.append(steps[-1] + 1 / math.log2(i + 1))
    return F.element_at(F.array(*(F.lit(s) for s in steps)), (F.least(total, F.lit(k)) + 1).cast("int"))


def group_metrics(df: DataFrame, ks: tuple[int, ...] = (5, 10), relevant: DataFrame | None = None) -> DataFrame:
    """group_id, candidates, relevant, mrr, map, and ndcg, hit, recall, precision at each k."""
    x = placed(df, relevant)
    top = lambda k: F.col("rank") <= k
    aggs = [
        F.max("n").alias("candidates"), F.max("total").alias("relevant"),
        F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))).cast("double"), F.lit(0.0)).alias("mrr"),
        (F.sum(F.when(F.col("hit") == 1, F.col("hits").cast("double") / F.col("rank")).otherwise(0.0)) / F.max("total")).alias("map"),
    ]
    for k in ks:
        gain = F.sum(F.when(top(k) & (F.col("hit") == 1), 1 / F.log2(F.col("rank").cast("double") + 1)).otherwise(0.0))
        got = F.sum(F.when(top(k), F.col("hit")).otherwise(0)).cast("double")
        has = F.max("n") >= k
        aggs += [
            F.when(has, gain / _ideal(F.max("total"), k)).alias(f"ndcg@{k}"), F.when(has, F.least(got, F.lit(1.0))).alias(f"hit@{k}"),
            F.when(has, got / F.max("total")).alias(f"recall@{k}"), F.when(has, got / k).alias(f"precision@{k}"),
        ]
    return x.where("total > 0").groupBy("group_id").agg(*aggs)


def summary(df: DataFrame, groups: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """metric, value (mean, 6 decimals), std (population), groups that have it; and the counters num_groups, num_valid, num_skipped."""
    names = ["mrr", "map", *(f"{m}@{k}" for k in ks for m in ("ndcg", "hit", "recall", "precision"))]
    c = lambda n: F.col(f"`{n}`")
    wide = groups.agg(*(F.struct(F.round(F.avg(c(n)), 6).alias("value"), F.round(F.stddev_pop(c(n)), 6).alias("std"), F.count(c(n)).alias("group_count")).alias(n) for n in names))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c(n).alias("v")) for n in names))).alias("x")).select("x.metric", "x.v.*")


def counters(df: DataFrame) -> DataFrame:
    """num_groups, num_valid (with a relevant candidate), num_skipped."""
    g = df.groupBy("group_id").agg(F.max((F.col("relevance") > 0).cast("int")).alias("ok"))
    return g.agg(F.count(F.lit(1)).alias("num_groups"), F.sum("ok").cast("bigint").alias("num_valid")).withColumn("num_skipped", F.col("num_groups") - F.col("num_valid"))


def by_k(summary_rows: DataFrame) -> DataFrame:
    """k, ndcg, hit, recall, precision from metric names of the form name@k."""
    x = summary_rows.where(F.col("metric").contains("@")).select(F.split_part("metric", F.lit("@"), F.lit(1)).alias("m"), F.split_part("metric", F.lit("@"), F.lit(2)).cast("int").alias("k"), "value")
    return x.groupBy("k").pivot("m", ["ndcg", "hit", "recall", "precision"]).agg(F.first("value"))
