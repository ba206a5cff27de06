"""What models and datasets offer each other: capabilities of models, and adapters that name a dataset's tables.

A model may have any of the capabilities; ``capabilities`` lists those it has. What
they exchange are frames: rows with ``y_score``, candidates (group_id, candidate_id,
score), or rows a task. There is one engine, Spark; a model that needs another brings
its own ``mapInPandas``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.operators import itemcf


@runtime_checkable
class Trainable(Protocol):
    def fit(self, train: DataFrame) -> "Trainable": ...


@runtime_checkable
class Pointwise(Protocol):
    def score_rows(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``y_score``."""


@runtime_checkable
class Ranker(Protocol):
    def rank(self, candidates: DataFrame) -> DataFrame:
        """(group_id, candidate_id, score) of the candidates (group_id, candidate_id)."""


@runtime_checkable
class Multitask(Protocol):
    def score_tasks(self, rows: DataFrame) -> DataFrame:
        """(task_name, ..., y_score): a row a task and input row."""


@runtime_checkable
class TopItems(Protocol):
    def top_items(self, users: DataFrame, k: int) -> DataFrame:
        """(u, rank, item_id, score, sim_sum) of the users (u)."""


@runtime_checkable
class Stored(Protocol):
    def save(self, path: str) -> None: ...

    def load(self, spark: SparkSession, path: str) -> "Stored": ...


@runtime_checkable
class Embeds(Protocol):
    def embed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``vector``."""


CAPABILITIES = {"trainable": Trainable, "pointwise": Pointwise, "ranker": Ranker, "multitask": Multitask, "top_items": TopItems, "stored": Stored, "embeds": Embeds}


def capabilities(model: object) -> list[str]:
    return [n for n, c in CAPABILITIES.items() if isinstance(model, c)]


class Dataset(ABC):
    """A dataset as named frames and a split: a subclass says where the tables are and how rows part."""

    @abstractmethod
    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The tables by name; the main one under ``dataset``, ``seq`` or ``train`` (see sources.tables.from_raw)."""

    @abstractmethod
    def split(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column ``split`` of train, val and test."""

    def parts(self, spark: SparkSession) -> dict[str, DataFrame]:
        from sparrowlake.sources.tables import from_raw

        rows, _ = from_raw(spark, self.tables(spark), max_rows=2**62)
        parted = self.split(rows)
        return {n: parted.where(F.col("split") == n).drop("split") for n in ("train", "val", "test")}


class ItemModel:
    """Item similarities as a model that is trained, asked for the best unseen items, ranks candidates, and is stored."""

    def __init__(self, similarity: Callable[[DataFrame, int], DataFrame] = itemcf.cosine, neighbours: int = 20, user: str = "user_id", item: str = "item_id") -> None:
        self.similarity, self.neighbours, self.user, self.item = similarity, neighbours, user, item
        self.history: DataFrame | None = None
        self.near: DataFrame | None = None

    def fit(self, train: DataFrame) -> "ItemModel":
        self.history = itemcf.pairs(train, self.user, self.item)
        self.near = self.similarity(self.history, self.neighbours).select("item_i", "item_j", "sim")
        return self

    def top_items(self, users: DataFrame, k: int) -> DataFrame:
        return itemcf.top_unseen(self.history.join(users.select("u").distinct(), "u", "left_semi"), self.near, k)

    def rank(self, candidates: DataFrame) -> DataFrame:
        near = self.near.select(F.col("item_i").alias("i"), F.col("item_j").alias("candidate_id"), "sim")
        x = candidates.join(self.history.select(F.col("u").alias("group_id"), "i"), "group_id", "left").join(near, ["i", "candidate_id"], "left")
        return x.groupBy("group_id", "candidate_id").agg(F.coalesce(F.sum("sim"), F.lit(0.0)).alias("score"))

    def save(self, path: str) -> None:
        self.history.write.mode("overwrite").parquet(f"{path}/history")
        self.near.write.mode("overwrite").parquet(f"{path}/near")

    def load(self, spark: SparkSession, path: str) -> "ItemModel":
        self.history, self.near = spark.read.parquet(f"{path}/history"), spark.read.parquet(f"{path}/near")
        return self
