"""Losses of whole score vectors, of embeddings and of several tasks, as row expressions (see ``columns`` for those of one score)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowlake.functions.columns import bce_with_logits, cosine, top1_loss


def log_sum_exp(logits: Column) -> Column:
    """ln(sum(exp(x))) over an array, shifted by its largest value."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-ln softmax(logits)[target]; target is a class number from 0."""
    return log_sum_exp(logits) - F.get(logits, target)


def top1_list(scores: Column, target: Column) -> Column:
    """TOP1 over all items: summed over those that are not the target."""
    own = F.get(scores, target)
    return F.aggregate(F.transform(scores, lambda x, i: F.when(i == target, F.lit(0.0)).otherwise(top1_loss(own, x))), F.lit(0.0), lambda s, x: s + x)


def info_nce(anchor: Column, positive: Column, negatives: Column, temperature: float = 0.07) -> Column:
    """Cross entropy of the anchor's cosine to its positive among those to the negatives (an array of vectors; null: none)."""
    near = cosine(anchor, positive) / temperature
    far = F.transform(F.coalesce(negatives, F.array().cast("array<array<double>>")), lambda v: cosine(anchor, v) / temperature)
    return log_sum_exp(F.concat(F.array(near), far)) - near


def sigmoid_focal_loss(y: Column, logit: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss from a logit; y may lie between 0 and 1."""
    p = 1 / (1 + F.exp(-logit))
    own = p * y + (1 - p) * (1 - y)
    return (alpha * y + (1 - alpha) * (1 - y)) * F.pow(1 - own, F.lit(gamma)) * bce_with_logits(y, logit)


def weighted_tasks(losses: dict[str, Column], weights: dict[str, float] = {}) -> Column:  # noqa: B006
    """The tasks' losses by their weights (1 where none is given)."""
    return sum((loss * weights.get(name, 1.0) for name, loss in losses.items()), F.lit(0.0))


def uncertain_tasks(losses: list[Column], log_vars: list[float]) -> Column:
    """sum(exp(-s) * loss + s) with each task's log variance s."""
    return sum((loss * F.exp(F.lit(-s)) + s for loss, s in zip(losses, log_vars, strict=True)), F.lit(0.0))
