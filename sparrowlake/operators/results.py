"""Experiment results: rows (run_id, model, dataset, seed, status, metric, duration)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matrix(models: DataFrame, datasets: DataFrame, seeds: DataFrame) -> DataFrame:
    """run_id, model, dataset, seed, config_hash for each combination of three small lists."""
    x = models.crossJoin(datasets).crossJoin(seeds)
    config = F.sha2(F.to_json(F.struct("dataset", "model", "seed")), 256)
    return x.withColumn("config_hash", F.substring(config, 1, 8)).withColumn("run_id", F.concat_ws("__", F.lit("exp"), "dataset", "model", F.concat(F.lit("seed"), F.col("seed")), "config_hash"))


def resume_plan(plan: DataFrame, status: DataFrame, mode: str = "successful_skip") -> DataFrame:
    """model, dataset, seed, action (run or skip) of planned runs against the known status."""
    x = plan.join(status, ["model", "dataset", "seed"], "left")
    s = F.coalesce("status", F.lit("missing"))
    skip = {"successful_skip": s == "succeeded", "failed_only": s != "failed", "unfinished_only": s.isin("succeeded", "failed"), "force": F.lit(False)}[mode]
    return x.select("model", "dataset", "seed", s.alias("status"), F.when(skip, "skip").otherwise("run").alias("action"))


def summary_rows(runs: DataFrame, metrics: str, names: list[str]) -> DataFrame:
    """A run a row, its metric map pivoted to columns."""
    return runs.select(*[c for c in runs.columns if c != metrics], *(F.col(metrics)[n].alias(n) for n in names))


def leaderboard(runs: DataFrame) -> DataFrame:
    """model, dataset, runs, mean, std (sample, 0 for one run), rank by mean; succeeded runs only."""
    g = runs.where("status = 'succeeded'").groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("metric"), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp("metric"), F.lit(0.0)), 9).alias("std"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "model", "dataset")))  # a row a model and dataset


def stability(runs: DataFrame) -> DataFrame:
    """Over two seeds or more: mean, std, cv = |std / mean|, min, max."""
    g = runs.where("status = 'succeeded'").groupBy("model", "dataset").agg(F.countDistinct("seed").alias("seeds"), F.avg("metric").alias("m"), F.stddev_samp("metric").alias("s"), F.min("metric").alias("min"), F.max("metric").alias("max"))
    return g.where("seeds >= 2").select("model", "dataset", "seeds", F.round("m", 9).alias("mean"), F.round("s", 9).alias("std"), F.round(F.abs(F.try_divide(F.col("s"), F.col("m"))), 9).alias("cv"), "min", "max")


def trend(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'succeeded'").groupBy("model", "seed").agg(F.round(F.avg("metric"), 9).alias("metric"), F.round(F.sum("duration"), 4).alias("duration"))


def failures(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'failed'").groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("failed_runs"), F.min("seed").alias("first_seed"))


def speedup(runs: DataFrame) -> DataFrame:
    """model, duration statistics, speedup = fastest run of all / the model's mean; with a column ``memory`` also its mean and largest value."""
    fastest = runs.agg(F.min("duration").alias("f"))
    memory = [F.round(F.avg("memory"), 6).alias("mean_memory"), F.max("memory").alias("max_memory")] if "memory" in runs.columns else []
    g = runs.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.avg("duration").alias("d"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), *memory)
    names = ["mean_memory", "max_memory"] if memory else []
    return g.crossJoin(F.broadcast(fastest)).select("model", "runs", F.round("d", 6).alias("mean_duration"), "min_duration", "max_duration", F.round(F.col("f") / F.col("d"), 6).alias("speedup"), *names)


def ablation(runs: DataFrame, parameter: str, base: object) -> DataFrame:
    """model, value, runs, mean, std, change, relative_change: one parameter varied, against the model's mean at its base value; succeeded runs."""
    g = runs.where("status = 'succeeded'").groupBy("model", F.col(parameter).alias("value")).agg(F.count(F.lit(1)).alias("runs"), F.avg("metric").alias("m"), F.coalesce(F.stddev_samp("metric"), F.lit(0.0)).alias("s"))
    at = g.where(F.col("value") == base).select("model", F.col("m").alias("b"))
    x = g.join(at, "model", "left")
    return x.select("model", "value", "runs", F.round("m", 9).alias("mean"), F.round("s", 9).alias("std"), F.round(F.col("m") - F.col("b"), 9).alias("change"), F.round(F.try_divide(F.col("m") - F.col("b"), F.abs("b")), 6).alias("relative_change"))


def overall_status(runs: DataFrame) -> DataFrame:
    """dataset, status: succeeded, partial_success or failed."""
    ok = F.avg((F.col("status") == "succeeded").cast("double"))
    return runs.groupBy("dataset").agg(F.when(ok == 1, "succeeded").when(ok > 0, "partial_success").otherwise("failed").alias("overall"))
