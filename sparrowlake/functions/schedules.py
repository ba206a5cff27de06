"""Learning rates by step, as closed forms over a step column (from 0)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _cos(t: Column, total: float, high: float, low: float) -> Column:
    return low + (high - low) * (1 + F.cos(math.pi * t / total)) / 2


def cosine(t: Column, lr: float, total: int = 100, low: float = 0.0) -> Column:
    return _cos(t, total, lr, low)


def cosine_warmup(t: Column, lr: float, total: int = 100, warmup: int = 0, low: float = 0.0, start: float = 0.01) -> Column:
    """From ``start`` times the rate in even steps, then the cosine over what is left."""
    if not warmup:
        return cosine(t, lr, total, low)
    return F.when(t < warmup, lr * (start + (1 - start) * t / warmup)).otherwise(_cos(t - warmup, max(1, total - warmup), lr, low))


def step(t: Column, lr: float, size: int = 10, gamma: float = 0.1) -> Column:
    return lr * F.pow(F.lit(gamma), F.floor(t / size))


def multi_step(t: Column, lr: float, milestones: tuple[int, ...] = (30, 60, 90), gamma: float = 0.1) -> Column:
    return lr * F.pow(F.lit(gamma), sum(((t >= m).cast("int") for m in milestones), F.lit(0)))


def polynomial(t: Column, lr: float, total: int = 100, power: float = 1.0) -> Column:
    return lr * F.pow(1 - F.least(t, F.lit(total)) / total, F.lit(power))


def onecycle(t: Column, lr: float, total: int, rise: float = 0.3, first: float = 25.0, last: float = 1e4) -> Column:
    """Up to ``lr`` from lr / first over the ``rise`` share of the steps, then down to lr / first / last, by half cosines."""
    top = rise * total - 1
    return F.when(t <= top, _cos(top - t, max(top, 1e-9), lr, lr / first)).otherwise(_cos(t - top, total - 1 - top, lr, lr / first / last))


def plateau(losses: list[float], lr: float, factor: float = 0.1, patience: int = 5, threshold: float = 1e-4) -> list[float]:
    """The rate after each loss: it falls when more than ``patience`` losses in a row are no better (by ``threshold``) than the best; a run's losses are few."""
    out, best, bad = [], math.inf, 0
    for x in losses:
        best, bad = (x, 0) if x < best * (1 - threshold) else (best, bad + 1)
        if bad > patience:
            lr, bad = lr * factor, 0
        out.append(lr)
    return out


def curve(spark: SparkSession, steps: int, rates: dict[str, Column]) -> DataFrame:
    """step, and a column for each named rate over the column ``step``."""
    return spark.range(steps).withColumnRenamed("id", "step").select("step", *(r.alias(n) for n, r in rates.items()))
