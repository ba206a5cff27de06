"""Classification metrics over rows (y, score[, weight]); y is 0 or 1. Undefined ratios are 0 where the metric says so, else null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlake.functions.columns import log_loss
from sparrowlake.operators.distribution import rank_auc
from sparrowlake.operators.ordered import following, number_bucket, running


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 on an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, threshold: float = 0.5, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """tp, fp, tn, fn (rows) and prevalence at a threshold."""
    hit = F.col("score") >= threshold
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    y = F.col("y") == 1
    return df.groupBy(*keys).agg(count(y & hit).alias("tp"), count(~y & hit).alias("fp"), count(~y & ~hit).alias("tn"), count(y & ~hit).alias("fn")).withColumn("prevalence", F.round(_ratio(F.col("tp") + F.col("fn"), F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")), 6))


def suite(df: DataFrame, threshold: float = 0.5, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """accuracy, precision, recall, f1, specificity, npv, fpr, fnr, balanced_accuracy at a threshold; 6 decimals."""
    c = confusion(df, threshold, keys)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall, specificity = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    r = lambda x, n: F.round(x, 6).alias(n)
    return c.select(
        *keys, r(_ratio(tp + tn, tp + tn + fp + fn), "accuracy"), r(precision, "precision"), r(recall, "recall"), r(_ratio(2 * tp, 2 * tp + fp + fn), "f1"), r(specificity, "specificity"),
        r(_ratio(tn, tn + fn), "npv"), r(1 - specificity, "fpr"), r(1 - recall, "fnr"), r((recall + specificity) / 2, "balanced_accuracy"),
    )


def log_loss_brier(df: DataFrame) -> DataFrame:
    y, p = F.col("y").cast("double"), F.col("score")
    return df.agg(F.round(F.avg(log_loss(y, p)), 6).alias("log_loss"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"))


def weighted(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Weighted accuracy and error: sum(w x) / sum(w)."""
    right = ((F.col("score") >= threshold).cast("int") == F.col("y")).cast("double")
    w = F.col("weight")
    return df.agg(F.round(_ratio(F.sum(w * right), F.sum(w)), 6).alias("weighted_accuracy"), F.round(_ratio(F.sum(w * F.pow(F.col("score") - F.col("y"), F.lit(2))), F.sum(w)), 6).alias("weighted_brier"))


def roc_auc(df: DataFrame) -> DataFrame:
    return rank_auc(df.select("y", "score")).select(F.round("auc", 6).alias("roc_auc"))


def thresholds(df: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """score, pos, neg, tp, fp at each distinct score taken as the threshold, and the totals p and n. Rows shrink to one a distinct score before they are ordered. Keys are not null."""
    h = df.groupBy(*keys, "score").agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))
    cum = running(h, number_bucket(F.col("score")), [F.desc("score")], ["pos", "neg"], True, keys)
    totals = h.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))  # a row a key
    both = cum.join(totals, keys) if keys else cum.crossJoin(F.broadcast(totals))
    return both.select(*keys, "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "p", "n")


def average_precision(df: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Sum of precision times the recall gained, over distinct thresholds downwards."""
    t = thresholds(df, keys)
    step = F.col("pos").cast("double") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return t.groupBy(*keys).agg(F.round(F.sum(F.when(F.col("p") > 0, step)), 6).alias("average_precision"))


def roc_curve(df: DataFrame) -> DataFrame:
    """threshold, fpr, tpr: the corners of the curve (points on a straight line between their neighbours are left out) after (0, 0) at infinity."""
    t = following(thresholds(df), "score", ["pos", "neg"])
    # a corner: the step to this point and the step from it differ in direction; the first and the last point are corners
    corner = F.col("neg") * F.col("next_pos") != F.col("next_neg") * F.col("pos")
    x = t.where(F.coalesce(corner, F.lit(True)))
    points = x.select(F.col("score").alias("threshold"), F.round(F.col("fp").cast("double") / F.col("n"), 6).alias("fpr"), F.round(F.col("tp").cast("double") / F.col("p"), 6).alias("tpr"))
    return df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).unionByName(points)


def pr_curve(df: DataFrame) -> DataFrame:
    """threshold, precision, recall at each distinct score, and the last point (1, 0) without a threshold."""
    t = thresholds(df).select(F.col("score").alias("threshold"), F.round(F.col("tp").cast("double") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp").cast("double") / F.col("p"), 6).alias("recall"))
    return t.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def threshold_sweep(df: DataFrame, values: list[float]) -> DataFrame:
    """The suite at each of a few thresholds, in one pass: each row meets the stated thresholds."""
    rows = df.select("y", "score", F.explode(F.array(*(F.lit(float(v)) for v in values))).alias("threshold"))
    return suite(rows.withColumn("score", (F.col("score") >= F.col("threshold")).cast("double")), 0.5, ["threshold"])


def multiclass(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support of each class of the truth or the prediction."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("s")), F.struct(F.col("p").alias("c"), F.lit(0).alias("s")))).alias("x"), "t", "p", "n").select("x.*", "t", "p", "n")
    x = sides.groupBy(F.col("c").alias("class")).agg(F.sum(F.when((F.col("s") == 1) & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("hit"), F.sum(F.when(F.col("s") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("s") == 0, F.col("n")).otherwise(0)).alias("predicted"))
    return x.select("class", "hit", "support", "predicted", _ratio(F.col("hit"), F.col("predicted")).alias("precision"), _ratio(F.col("hit"), F.col("support")).alias("recall"), _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"))


def multiclass_macro(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, macro, micro and weighted averages over the classes."""
    x = multiclass(df, truth, predicted)
    r = lambda c, n: F.round(c, 6).alias(n)
    return x.agg(
        r(_ratio(F.sum("hit"), F.sum("support")), "accuracy"), r(F.avg("precision"), "precision_macro"), r(F.avg("recall"), "recall_macro"), r(F.avg("f1"), "f1_macro"),
        r(_ratio(2 * F.sum("hit"), F.sum("support") + F.sum("predicted")), "f1_micro"), r(_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), "f1_weighted"),
    )


def multiclass_scores(df: DataFrame, truth: str, scores: str) -> DataFrame:
    """multiclass_macro of the class with the largest score (the first of equal ones), roc_auc_macro of each class against the rest, and log_loss; classes are numbers from 0."""
    predicted = F.array_position(scores, F.array_max(scores)) - 1
    x = df.select(F.col(truth).cast("bigint").alias("t"), F.col(scores).alias("s"), predicted.alias("p"))
    each = x.select("t", F.posexplode("s").alias("class", "score")).select("class", (F.col("t") == F.col("class")).cast("int").alias("y"), "score")
    auc = rank_auc(each, ["class"]).agg(F.round(F.avg("auc"), 6).alias("roc_auc_macro"))
    own = F.greatest(F.get("s", F.col("t").cast("int")) / F.aggregate("s", F.lit(0.0), lambda a, v: a + v), F.lit(1e-15))
    loss = x.agg(F.round(F.avg(-F.log(F.least(own, F.lit(1 - 1e-15)))), 6).alias("log_loss"))
    return multiclass_macro(x, "t", "p").crossJoin(F.broadcast(auc)).crossJoin(F.broadcast(loss))  # one row each


def threshold_of(strategy: str, fixed: float = 0.5, stated: list[float] | None = None) -> float:
    """The decision threshold: 'bundle' takes the first that the predictions state; 'fixed', 'tuned_on_val' and 'per_task' the given one."""
    if strategy not in ("fixed", "bundle", "tuned_on_val", "per_task"):
        raise ValueError(f"unknown threshold strategy {strategy}")
    return stated[0] if strategy == "bundle" and stated else fixed


def by_task(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """task, accuracy, f1, roc_auc, average_precision over rows (task, y, score, mask) whose mask holds."""
    x = df.where("mask").select("task", "y", "score")
    out = suite(x, threshold, ["task"]).select("task", "accuracy", "f1")
    auc = rank_auc(x, ["task"]).select("task", F.round("auc", 6).alias("roc_auc"))
    return out.join(auc, "task").join(average_precision(x, ["task"]), "task")


def macro(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*(F.round(F.avg(c), 6).alias(f"{c}_macro") for c in ("accuracy", "f1", "roc_auc", "average_precision")))
