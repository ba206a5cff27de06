"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

A test item with n shingles lies in a document if at least num/den of its distinct
shingles are among the document's. Jaccard similarity says little between a short item
and a long document, so documents are partitioned by set size (powers of two) and
items by theirs. For each pair of partitions the number of bins of a one-permutation
MinHash sketch of the document is set from the largest document and the smallest item
of the partitions: each bin keeps its smallest shingle, and so many bins are used that
a contained item is expected to own ``EXPECTED`` of the minima or more. Where that takes
all shingles, all are kept. An item none of whose shingles is a minimum is missed with
probability exp(-EXPECTED) at most. The minima are looked up in an index of the items'
shingles, and each candidate is confirmed by counting the item's shingles in the
document's full set.

The index is broadcast in blocks of items of ``BLOCK_SHINGLES`` shingles (32 MB): items are
dealt to buckets by hash, and buckets are put together up to that bound by their measured
sizes. A larger benchmark takes a pass over the documents for each block, and each pass is
written before the next begins, so a worker holds one block at a time; none shuffles a text.

Sets: A-Z in lower case, words between ASCII white space, k-word shingles; a text with
fewer than k words has its whole sequence as its one shingle, so a short item is found
only as a whole text, or with ``short_inside`` also among the document's shingles of the
item's own length. Nulls and texts without words have the empty set: such documents
hold nothing, such items are in nothing. Repeated items of one id and text count once;
equal texts under other ids are reported under each. Items without an id are ignored.
A very long text is one slice: its shingles are sketched at once. Ties: an item is
found or not by itself, whatever others are. Repeated documents are judged alike, columns named ``leaks`` are replaced, all others
carried along; empty tables on either side give no leaks. Item ids are BIGINT.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.llm.common import U64, Memo, add_columns, drop, mix64, raw, shingles, stage, word_hashes
from sparrowlake.llm.near_dup import shingle_sets

EXPECTED = 20
BLOCK_SHINGLES = 2_000_000
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("common", T.IntegerType()), T.StructField("shingles", T.IntegerType())]))


def load_of(least_common: float) -> float:
    """The mean elements a bin at which (1 - exp(-load)) / load of the shingles are minima and least_common of them give EXPECTED; 0: keep all."""
    share = EXPECTED / least_common
    if share >= 1:
        return 0.0
    low, high = 0.0, 1 / share
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if -np.expm1(-mid) / mid > share else (low, mid)
    return low


class Index:
    """The items of a block: their shingles by size class, and which items hold each shingle; ``short``: by their one shingle, the items of each length under k."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], num: int, den: int, short: dict[int, dict[int, list[int]]] | None = None) -> None:
        self.ids, self.sets, self.num, self.den, self.short = ids, sets, num, den, short or {}
        self.classes = []
        size = np.array([len(s) for s in sets], np.int64)
        for c in sorted({int(n).bit_length() for n in size}):
            members = np.flatnonzero([int(n).bit_length() == c for n in size])
            flat = np.concatenate([sets[i] for i in members])
            of = np.repeat(members, size[members])
            order = np.argsort(flat, kind="stable")
            keys, first = np.unique(flat[order], return_index=True)
            self.classes.append((load_of(num / den * (1 << (c - 1))), keys, np.append(first, len(flat)), of[order]))

    def inside(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, 1, 1) of the short items whose whole sequence is among the word hashes."""
        found: set[int] = set()
        for length, held in self.short.items():
            if len(words) >= length:
                for s in held.keys() & set(shingles(words, length).tolist()):
                    found.update(held[s])
        return [(i, 1, 1) for i in found]

    def leaks(self, shingles: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, common, size) of the items that the sorted distinct shingles contain."""
        found: set[int] = set()
        if not len(shingles):
            return []
        upper = 1 << len(shingles).bit_length()  # the largest document of the size partition
        mixed = None
        for load, keys, first, of in self.classes:
            sketch = shingles
            if load:
                mixed = mix64(shingles ^ U64(0xA0761D6478BD642F)) if mixed is None else mixed
                bins = (mixed >> U64(20)) % U64(max(1, int(np.ceil(upper / load))))
                order = np.lexsort((mixed, bins))
                sketch = shingles[order[np.append(True, np.diff(bins[order]) > 0)]]
            at = np.minimum(np.searchsorted(keys, sketch), len(keys) - 1)
            for i in at[keys[at] == sketch]:
                found.update(of[first[i] : first[i + 1]].tolist())
        out = []
        for i in found:
            item = self.sets[i]
            at = np.minimum(np.searchsorted(shingles, item), len(shingles) - 1)
            common = int((shingles[at] == item).sum())
            if self.den * common >= self.num * len(item):
                out.append((self.ids[i], common, len(item)))
        return sorted(out)


def item_sets(benchmark: DataFrame, item_id: str, text: str, k: int) -> DataFrame:
    """item_id, n, the distinct shingles and the words (k at most) of each item that has any."""

    def run(batches):
        memo = Memo()
        for b in batches:
            sets = shingle_sets(b.column(1), k, memo)
            length = [min(k, len(word_hashes(t, memo))) for t in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(length, pa.int32())], names=["item_id", "n", "set", "words"])

    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id IS NOT NULL")
    return rows.mapInArrow(run, "item_id long, n long, set array<long>, words int").where("n > 0").distinct()


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, num: int = 80, den: int = 100, short_inside: bool = False) -> DataFrame:
    """``docs`` with ``leaks``: the items that each text contains, as structs (item_id, common, shingles) by item_id."""
    spark = docs.sparkSession
    items, _ = stage(item_sets(benchmark, item_id, item_text, k), "items")
    blocks, buckets = _blocks(items)
    parts, written = [], None
    for b, block in enumerate(blocks):
        rows = items.where(_bucket(buckets).isin(block)).select("item_id", "set", "words").toArrow().combine_chunks()
        ids, sets, short = rows["item_id"].to_pylist(), [np.array(x, np.int64).view(U64) for x in rows["set"].to_pylist()], {}
        for i, x, n in zip(ids, sets, rows["words"].to_pylist()):
            if short_inside and n < k:
                short.setdefault(n, {}).setdefault(int(x[0]), []).append(i)
        index = spark.sparkContext.broadcast(Index(ids, sets, num, den, short))

        def make(index=index):
            memo = Memo()

            def found(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
                out = [index.value.leaks(s) for s in shingle_sets(texts, k, memo)]
                if index.value.short:
                    out = [sorted({*x, *index.value.inside(word_hashes(t, memo))}) for x, t in zip(out, raw(texts))]
                return out

            return lambda texts: [pa.array([[{"item_id": i, "common": c, "shingles": n} for i, c, n in x] for x in found(texts)], T_LEAK)]

        parts.append(f"_leaks{b}" if len(blocks) > 1 else "leaks")
        docs = add_columns(docs, text, [T.StructField(parts[-1], LEAK)], make)
        if len(blocks) > 1:
            docs, path = stage(docs, f"pass-{b}")
            index.unpersist()
            if written:
                drop(spark, written)
            written = path
    return docs if len(blocks) == 1 else docs.withColumn("leaks", F.array_sort(F.concat(*parts))).drop(*parts)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "set"), F.lit(buckets))


def _blocks(items: DataFrame) -> tuple[list[list[int]], int]:
    """Buckets of items in lists of at most BLOCK_SHINGLES shingles (a bucket beyond that stands alone), and how many buckets there are."""
    total, n = items.agg(F.sum("n"), F.count(F.lit(1))).first()
    buckets = min(8 * -(-(total or 0) // BLOCK_SHINGLES), 2 * n) or 1
    size = {r.bucket: r["size"] for r in items.groupBy(_bucket(buckets).alias("bucket")).agg(F.sum("n").alias("size")).collect()}  # eight rows a block
    out, held = [[]], 0
    for i in range(buckets):
        if held and held + size.get(i, 0) > BLOCK_SHINGLES:
            out.append([])
            held = 0
        out[-1].append(i)
        held += size.get(i, 0)
    return out, buckets


T_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("common", pa.int32()), ("shingles", pa.int32())]))
