"""Approximate nearest neighbours by cosine: hierarchical k-means tree, best-bin-first search.

``fit`` builds the tree on a bounded sample: a node of unit vectors is split by spherical
k-means into ``BRANCH`` children until it is small. The sample has 64 sqrt(N) of the N
rows, ``SAMPLE_ROWS[0]`` at least and ``SAMPLE_ROWS[1]`` at most, so the leaves grow with the
table, and a leaf's rows no faster than its square root up to that bound. It then calibrates the search: for held queries of the sample it ranks the leaves as
the traversal would visit them, and takes the least number of leaf visits that finds
the target share of the true neighbours. ``search`` indexes every row by its leaf,
walks the tree for each query with a priority queue of nodes by their distance, visits
at least the calibrated number of leaves and as many more as hold k rows, and compares
the query with all rows of the leaves it visits.

Rows of a leaf meet the queries that visit it in a co-grouped task. A leaf with many
rows is cut into chunks and one with many queries into blocks, so no task holds more
than ``CHUNK`` vectors and ``BLOCK`` queries, however hot a leaf is; each task returns k
rows a query. Nearness is the cosine in double precision of the original vectors; rows
at equal nearness go by the smaller id.

Nulls: vectors that are null, zero, of another length than the sample's (its commonest one, the smallest of several), or
hold null or non-finite components take no part, as query or candidate, nor do rows without an
id. Repeated rows are candidates each, except the query's own id. As queries, repeated
rows of one id and vector are one; an id with several vectors is a query for each, ranked
by itself. With fewer than k
candidates all are returned; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlake.llm.common import stage

SAMPLE_ROWS, BRANCH, LEAF_ROWS, TARGET = (16_384, 262_144), 8, 64, 0.97
CHUNK, BLOCK, STEP = 4096, 16_384, 512


@dataclass
class Tree:
    """Nodes by number (0: the root): unit centres, children (empty: a leaf), and the leaves' numbers."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    visits: int = 1

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at each level."""
        out = np.zeros(len(unit), np.int32)
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            own = (unit[rows] @ self.centres[self.children[node]].T).argmax(1)
            todo += [(c, rows[own == j]) for j, c in enumerate(self.children[node]) if (own == j).any()]
        return out

    def order(self, unit: np.ndarray):
        """The leaves in best-bin-first order, lazily: the nearest node waiting in the queue is opened next."""
        near = self.centres @ unit
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                best, *rest = sorted(self.children[node], key=lambda c: (-near[c], c))
                for c in rest:
                    heapq.heappush(queue, (-near[c], c))
                node = best
            yield self.leaf[node]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres, (x @ centres.T).argmax(1)


def grow(unit: np.ndarray, seed: int = 42) -> Tree:
    rng, dim = np.random.default_rng(seed), unit.shape[1]
    centres, children, leaf, todo = [np.zeros(dim)], [[]], [-1], [(0, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) > LEAF_ROWS:
            c, own = _kmeans(unit[rows], min(BRANCH, len(rows)), rng)
            used = [j for j in range(len(c)) if (own == j).any()]
            if len(used) > 1:  # equal vectors can't be split: they stay one leaf
                for j in used:
                    children[node].append(len(centres))
                    todo.append((len(centres), rows[own == j]))
                    centres.append(c[j])
                    children.append([])
                    leaf.append(-1)
    for i, n in enumerate(i for i, c in enumerate(children) if not c):
        leaf[n] = i
    return Tree(np.array(centres), children, leaf)


def calibrate(tree: Tree, unit: np.ndarray, k: int, target: float, queries: int = 256) -> int:
    """The least number of leaf visits that finds ``target`` of the k nearest rows, over queries from the sample."""
    if len(unit) < 2:
        return 1
    own, needed = tree.assign(unit), []
    for q in range(0, len(unit), max(1, len(unit) // queries)):
        near = unit @ unit[q]
        near[q] = -2
        best = np.argpartition(-near, min(k, len(unit) - 1) - 1)[:k]
        place = {leaf: i + 1 for i, leaf in enumerate(tree.order(unit[q]))}
        needed += [place[own[b]] for b in best if b != q]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]


def usable(vector: Column) -> Column:
    """Whether a vector takes part (its length aside)."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def rows_of(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in vectors])


def units(x: np.ndarray) -> np.ndarray:
    return x / _norms(x)[:, None]


def _norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1)  # scaled, so that squares neither overflow nor vanish
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def _first_of_equal(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors; of equal vectors those of the first k + 1 ids, k of each id: what is left is no query's near row."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    seen: dict[bytes, tuple[int, int, int]] = {}  # the last id, how many ids, how many rows of the last id
    keep = []
    for i, v in enumerate(x):
        key = v.tobytes()
        last, n, rows = seen.get(key, (None, 0, 0))
        n, rows = (n, rows + 1) if last == ids[i] else (n + 1, 1)
        seen[key] = ids[i], n, rows
        if n <= k + 1 and rows <= k:
            keep.append(i)
    return ids[keep], x[keep]


def _best(u: np.ndarray, ids: np.ndarray, qs: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, vector's row, score) of the k nearest unit vectors of each query, less its own id; equal scores by the smaller id."""
    rough = qs @ u.T
    rough[query[:, None] == ids[None, :]] = -2
    cut = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(qs), -2.0)
    row, at = np.nonzero((rough >= cut[:, None] - 1e-9) & (rough > -1.5))
    score = (u[at] * qs[row]).sum(1)  # row by row in one order, so equal vectors score equally
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    first = np.searchsorted(row, row)
    top = np.arange(len(row)) - first < k
    return row[top], at[top], score[top]


def fit(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, sample_rows: tuple[int, int] = SAMPLE_ROWS, target: float = TARGET) -> tuple[Tree | None, int]:
    """The calibrated tree and the vectors' length; (None, 0) if no vector takes part."""
    rows = rows_of(df, vec_id, vector)
    wanted = min(max(int(64 * rows.count() ** 0.5), sample_rows[0]), sample_rows[1])
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(wanted).toPandas()
    if not len(picked):
        return None, 0
    size = picked["v"].map(len)
    dim = int(size.mode().iloc[0])
    x = units(matrix(picked["v"][size == dim]))
    tree = grow(x)
    tree.visits = calibrate(tree, x, k, target)
    return tree, dim


def search(df: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, fitted: tuple[Tree | None, int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each distinct id and vector where ``queries`` (a condition on vec_id) holds."""
    spark, out = df.sparkSession, "query_id long, rank int, vec_id long, score double"
    tree, dim = fitted or fit(df, vec_id, vector, k)
    if tree is None:
        return spark.createDataFrame([], out)
    held = spark.sparkContext.broadcast(tree)

    def index(batches):
        for b in batches:
            x = matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.assign(units(x)))], names=["vec_id", "v", "leaf"])

    rows, _ = stage(rows_of(df, vec_id, vector).where(F.size("v") == dim).mapInArrow(index, "vec_id long, v array<double>, leaf int"), "leaves")
    size = {r.leaf: r["count"] for r in rows.groupBy("leaf").count().collect()}  # one row a leaf: bounded by the sample

    def walk(batches):
        for b in batches:
            x = matrix(b.column(1).to_pylist())
            visited = []
            for u in units(x):
                some, seen = [], 0
                for leaf in held.value.order(u):
                    if len(some) >= held.value.visits and seen > k:
                        break
                    if size.get(leaf):
                        some.append(leaf)
                        seen += size[leaf]
                visited.append(some)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(visited, pa.list_(pa.int32()))], names=["query_id", "q", "vector", "visited"])

    distinct = rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct().withColumn("vector", F.xxhash64("q"))
    asked = distinct.mapInArrow(walk, "query_id long, q array<double>, vector long, visited array<int>")
    visits, _ = stage(asked.select("query_id", "q", "vector", F.explode("visited").alias("leaf")), "visits")
    load = {r.leaf: r["count"] for r in visits.groupBy("leaf").count().collect()}
    if not load:
        return spark.createDataFrame([], out)
    plan = spark.createDataFrame([(leaf, -(-size[leaf] // CHUNK), -(-load[leaf] // BLOCK)) for leaf in sorted(load)], "leaf int, chunks int, blocks int")
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(F.broadcast(plan), "leaf").withColumn("chunk", part("vec_id", "chunks")).withColumn("block", upto("blocks")).select("leaf", "chunk", "block", "vec_id", "v")
    right = visits.join(F.broadcast(plan), "leaf").withColumn("block", part("query_id", "blocks")).withColumn("chunk", upto("chunks")).select("leaf", "chunk", "block", "query_id", "q", "vector")

    def nearest(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asked):
            return pd.DataFrame({"query_id": [], "vector": [], "vec_id": [], "score": []})
        ids, x = _first_of_equal(vectors["vec_id"].to_numpy(), matrix(vectors["v"]), k)
        u, qs = units(x), units(matrix(asked["q"]))
        query, found = asked["query_id"].to_numpy(), []
        for i in range(0, len(qs), STEP):
            row, at, score = _best(u, ids, qs[i : i + STEP], query[i : i + STEP], k)
            found.append(pd.DataFrame({"query_id": query[i + row], "vector": asked["vector"].to_numpy()[i + row], "vec_id": ids[at], "score": score}))
        return pd.concat(found)

    near = left.groupBy("leaf", "chunk", "block").cogroup(right.groupBy("leaf", "chunk", "block")).applyInPandas(nearest, "query_id long, vector long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
