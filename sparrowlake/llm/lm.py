"""Language-model scoring with an Elias-Fano n-gram trie of two levels of context.

Level 0 and 1, the words: their 64-bit hashes in order, Elias-Fano coded, in shards by
the first bits; a word's id is its place. Each has its count's code. Level 2, the
successors: for each context word the ids of the words that follow it, made monotone
by adding the last value of the context before (values are context-relative), with
monotone pointers to each context's range and an 8-bit code of the smoothed
probability; each context has a 16-bit code of its back-off weight. A bigram is found by
looking its context up, taking the context's range from the pointers, and seeking the
successor of the relative value in that range.

p(w | c) = (n(c w) - D(n)) / n(c) + g(c) p(w), with modified Kneser-Ney discounts D for
counts of 1, 2 and more, g(c) the mass that they free, and p(w) = (n(w) + 1) / (N + V + 1),
which leaves 1 / (N + V + 1) to a word not seen. An unseen context backs off in full.
Without quantisation the probabilities after a context add up to 1.

There is one model for a corpus: the discounts come from the counts of all pairs, and
the codes of all shards stand on one grid, even in the logarithm, from the least
probability that a pair can have to 1. So a token's log10 probability is off by
``Model.bound`` at most, and neither the number of partitions nor the worker that runs a
task plays a part. The number of shards follows the bytes of the texts.

Building: tasks count words, and then pairs of ids, in numpy over bounded blocks, and
send each shard one packed row of sorted keys (differences, byte by byte) and counts,
so what is shuffled is a few bytes a distinct pair. Shards of pairs hold about
``SHARD_TOKENS`` tokens each: contexts are dealt in id order, and a context that is too
frequent for one shard is cut by the ids of its successors. Only the shards' sizes and
cuts reach the driver, and the weights of the contexts that are cut. Level files lie in
the shared folder and are memory-mapped by the tasks that score; a file is put in place
in one step, so tasks can run again. A folder that is not mounted (HDFS, an object store)
is reached through Arrow's file systems, and a task maps a copy in its node's own folder.

Nulls: a null text is empty: its only token is the end. Rows without an id are scored,
and trained on if the caller passes them. Repeated rows count each time. A very long text
is one slice of its own, counted in blocks of keys. Columns named
as an output are replaced, others carried along; without training rows every token is
unseen (N = V = 0) and scores log10(1). An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.llm import succinct
from sparrowlake.llm.common import U64, Memo, add_columns, drop, expire, hashed_words, new_path, slices
from sparrowlake.llm.succinct import EliasFano

#: The end of a text as a word; a word has no space.
END = U64(xxhash.xxh3_64_intdigest(b" end"))
BLOCK_KEYS, SHARD_TOKENS, SHARD_BYTES = 2_500_000, 4_000_000, 32 << 20
#: Bytes of text whose tokens are looked up together: a slice has a part of its own in nearly every shard, so few slices and few shards keep the number of these parts low.
SLICE_BYTES = 8 << 20
#: Words are dealt to 2^6 shards at least and 2^17 at most.
LEAST_BITS, MOST_BITS = 6, 17
PACKED = "shard int, n int, first long, keys binary, counts binary"


def tokens(texts: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, each followed by the end, and each text's number of tokens."""
    hashes, size = hashed_words(texts, memo)
    return np.insert(hashes, np.cumsum(size), END), size + 1


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The parts as one; the list is emptied before they are sorted."""
    keys, counts = (np.concatenate(x) for x in zip(*held))
    held.clear()
    return merged(keys, counts)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: what compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def packed(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """One row for each shard that has keys; shard s begins at cuts[s]."""
    shard = np.searchsorted(cuts, keys, "right") - 1
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else np.zeros(0, np.int64)
    rows = []
    for i, j in zip(at, [*at[1:], len(keys)]):
        k = keys[i:j]
        rows.append((int(shard[i]), int(j - i), int(k[:1].view(np.int64)[0]), _planes(np.diff(k)), _planes(counts[i:j].astype(np.int64))))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "n", "first", "keys", "counts"]) if rows else None


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.cumsum(np.concatenate([np.array([f], np.int64).view(U64), _unplanes(k, U64)]), dtype=U64) for f, k in zip(rows["first"], rows["keys"])]
    return merged(np.concatenate(keys), np.concatenate([_unplanes(c, np.int64) for c in rows["counts"]]))


def _counted(docs: DataFrame, cuts: np.ndarray, keys_of) -> DataFrame:
    """Packed rows of the keys that ``keys_of`` makes of a slice of texts (column 0), counted within blocks of a task."""

    def run(batches):
        of = keys_of()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in (x for batch in batches for x in slices(batch, 0, SLICE_BYTES)):
            k, c = np.unique(of(b.column(0)), return_counts=True)
            held.append((k, c.astype(np.int64)))
            size += len(k)
            if size > BLOCK_KEYS:
                held = [_together(held)]
                size = len(held[0][0])
                if size > BLOCK_KEYS // 2:
                    yield packed(*held[0], cuts)
                    held, size = [], 0
        if size:
            yield packed(*_together(held), cuts)

    return docs.mapInArrow(run, PACKED)


@dataclass
class Model:
    """Where the levels are, and the shards' sizes and cuts."""

    folder: str
    bits: int  # of a hash, for the shard of a word
    first: np.ndarray  # id of the first word of each shard of words
    tokens: int
    words: int
    cuts: np.ndarray  # first key (context id << 32 | word id) of each shard of pairs
    held: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # whether a pair fell between a shard's cuts
    least: float = 0.0  # the logarithm of the least probability that a pair can have
    taken: np.ndarray = field(default_factory=lambda: np.zeros(4))  # the discounts
    split: dict[int, float] = field(default_factory=dict)  # back-off weight of each context that is cut, added up over the shards that hold a part

    @property
    def bound(self) -> float:
        """What quantisation may change a token's log10 probability by."""
        return -self.least / 255 / 2 / np.log(10)

    @property
    def unseen(self) -> float:
        return 1.0 / (self.tokens + self.words + 1)


class Levels:
    """The mapped levels of a model, opened when they are first needed."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.vocab: dict[int, tuple] = {}
        self.pairs: dict[int, tuple] = {}
        self.grids: dict[int, np.ndarray] = {}

    def _grid(self, codes: int) -> np.ndarray:
        """One table of values for all shards."""
        if codes not in self.grids:
            self.grids[codes] = grid(self.m.least, codes)
        return self.grids[codes]

    def _vocab(self, s: int):
        if s not in self.vocab:
            a = succinct.load(self.m.folder, f"words/{s}")
            self.vocab[s] = (EliasFano.of(a, "hash"), a["count"], a["book"])
        return self.vocab[s]

    def _pairs(self, s: int):
        """A shard of pairs; None if no pair fell between its cuts."""
        if s not in self.pairs and not self.m.held[s]:
            self.pairs[s] = None
        if s not in self.pairs:
            a, b = succinct.load(self.m.folder, f"pairs/{s}"), succinct.load(self.m.folder, f"codes/{s}")
            self.pairs[s] = (EliasFano.of(a, "context"), EliasFano.of(a, "pointer"), EliasFano.of(a, "value"), b["code"], self._grid(256), b["back"], self._grid(65536))
        return self.pairs[s]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: not seen) and count of each of the sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> U64(64 - self.m.bits)).astype(np.int64) if self.m.bits else np.zeros(len(hashes), np.int64)
        for s, i, j in _runs(shard):
            if self.m.first[s + 1] > self.m.first[s]:
                ef, count, book = self._vocab(s)
                rest = hashes[i:j] & U64((1 << (64 - self.m.bits)) - 1) if self.m.bits else hashes[i:j]
                at = ef.find(rest, np.zeros(j - i, np.int64), np.full(j - i, ef.n))
                ok = at >= 0
                ids[i:j] = np.where(ok, at + self.m.first[s], -1)
                counts[i:j] = np.where(ok, book[count[np.maximum(at, 0)]], 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        for s, i, j in _runs(np.searchsorted(self.m.first, ids, "right") - 1):
            _, count, book = self._vocab(s)
            out[i:j] = book[count[ids[i:j] - self.m.first[s]]]
        return out

    def back(self, contexts: np.ndarray) -> np.ndarray:
        """The back-off weight of each of the sorted context ids."""
        out = np.ones(len(contexts))
        for s, i, j in _runs(np.searchsorted(self.m.cuts, contexts.astype(U64) << U64(32), "right") - 1):
            if (level := self._pairs(s)) is None:
                continue
            ef, _, _, _, _, back, book = level
            at = ef.find(contexts[i:j], np.zeros(j - i, np.int64), np.full(j - i, ef.n))
            out[i:j] = np.where(at >= 0, book[back[np.maximum(at, 0)]], 1.0)
        if len(contexts) and self.m.split:
            at = np.minimum(np.searchsorted(contexts, list(self.m.split)), len(contexts) - 1)
            for i, (c, g) in zip(at, self.m.split.items()):
                if contexts[i] == c:
                    out[i] = g
        return out

    def seen(self, keys: np.ndarray) -> np.ndarray:
        """The smoothed probability that the trie holds for each of the sorted pairs, 0 without."""
        out = np.zeros(len(keys))
        for s, i, j in _runs(np.searchsorted(self.m.cuts, keys, "right") - 1):
            if (level := self._pairs(s)) is None:
                continue
            contexts, pointers, values, code, book, _, _ = level
            context, word = (keys[i:j] >> U64(32)), keys[i:j] & U64(0xFFFFFFFF)
            own, of = np.unique(context, return_inverse=True)
            at = contexts.find(own, np.zeros(len(own), np.int64), np.full(len(own), contexts.n))
            ok = at >= 0
            at = np.maximum(at, 0)
            a, b = pointers.access(at).astype(np.int64), pointers.access(at + 1).astype(np.int64)
            base = np.where(a > 0, values.access(np.maximum(a - 1, 0)) + U64(1), U64(0))
            b = np.where(ok, b, a)
            place = values.find(base[of] + word, a[of], b[of])
            out[i:j] = np.where(place >= 0, book[code[np.maximum(place, 0)]], 0.0)
        return out


def _runs(shard: np.ndarray):
    """(value, begin, end) of each run of equal values."""
    if len(shard):
        at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(shard)]):
            yield int(shard[i]), i, j


@lru_cache(maxsize=1)
def _levels(folder: str) -> list:
    return []


def opened(model: Model) -> Levels:
    """The levels of a model, kept open between the tasks of a worker process; the model itself is always the caller's."""
    held = _levels(model.folder)
    if not held:
        held.append(Levels(model))
    held[0].m = model
    return held[0]


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2, and 3 or more: modified Kneser-Ney, from how many pairs have counts 1 to 4."""
    n = [max(1, x) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(c - (c + 1) * y * n[c] / n[c - 1], 0.05), c - 0.05) for c in (1, 2, 3))])


def grid(least: float, codes: int) -> np.ndarray:
    """The values that codes stand for: even in the logarithm, from exp(least) to 1."""
    return np.exp(np.linspace(least, 0.0, codes))


def coded(log: np.ndarray, least: float, codes: int) -> np.ndarray:
    """The nearest code of each logarithm."""
    return np.rint((1 - log / least) * (codes - 1)).clip(0, codes - 1).astype(np.uint8 if codes == 256 else np.uint16)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Build the levels over all texts of ``docs`` in the shared folder."""
    spark = docs.sparkSession
    texts, folder = docs.select(F.col(text).alias("text")), new_path(spark, "lm")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size // SHARD_BYTES).bit_length(), LEAST_BITS), MOST_BITS)
    cuts = np.arange(1 << bits, dtype=U64) << U64(64 - bits)

    def hashes():
        memo = Memo()
        return lambda t: tokens(t, memo)[0]

    def words(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        keys, counts = unpacked(rows)
        rest = keys & U64((1 << (64 - bits)) - 1)
        book, code = np.unique(counts, return_inverse=True)
        succinct.save(folder, f"words/{s}", **succinct.named("hash", EliasFano.build(rest)), count=code.astype(np.uint16 if len(book) < 65536 else np.uint32), book=book)
        total = np.cumsum(counts)
        targets = np.arange(SHARD_TOKENS, int(total[-1]), SHARD_TOKENS)
        at = np.searchsorted(total, targets, "right")
        share = (targets - (total[at] - counts[at])) / counts[at]
        share[counts[at] * 4 < SHARD_TOKENS] = 0  # only a very frequent word is cut
        return pd.DataFrame({"shard": [s], "size": [len(keys)], "tokens": [int(total[-1])], "most": [int(counts.max())], "at": [at], "share": [share]})

    found = _counted(texts, cuts, hashes).groupBy("shard").applyInPandas(words, "shard int, size long, tokens long, most long, at array<long>, share array<double>").collect()  # one row a shard
    size = np.zeros((1 << bits) + 1, np.int64)
    for r in found:
        size[r.shard + 1] = r["size"]
    first = np.cumsum(size)
    total, vocab = sum(r.tokens for r in found), int(first[-1])
    if vocab >= 1 << 32:
        raise ValueError("ids have 32 bits")
    pair_cuts, left = {0}, 0
    for r in sorted(found, key=lambda r: r.shard):
        if left + min(r.tokens, SHARD_TOKENS) > SHARD_TOKENS:  # else pairs of this shard's words go on in the shard before
            pair_cuts.add(int(first[r.shard]) << 32)
            left = 0
        pair_cuts |= {(int(first[r.shard] + i) << 32) + int(x * vocab) for i, x in zip(r.at, r.share)}
        left = r.tokens - SHARD_TOKENS * len(r.at) if len(r.at) else left + r.tokens
    model = Model(folder, bits, first, total, vocab, np.array(sorted(pair_cuts), U64))
    if not vocab:
        return model

    def pairs():
        memo, levels = Memo(), opened(model)

        def of(t: pa.Array) -> np.ndarray:
            flat, _ = tokens(t, memo)
            own, back = np.unique(flat, return_inverse=True)
            ids = levels.ids(own)[0].astype(U64)[back]
            end = levels.ids(np.array([END]))[0].astype(U64)
            return (np.concatenate([end, ids[:-1]]) << U64(32)) | ids

        return of

    def level(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        keys, counts = unpacked(rows)
        contexts, begin = np.unique(keys >> U64(32), return_index=True)
        word, pointer = keys & U64(0xFFFFFFFF), np.append(begin, len(keys))
        last = word[pointer[1:] - 1] + U64(1)
        base = np.cumsum(last, dtype=U64) - last
        succinct.save(
            folder, f"pairs/{s}", **succinct.named("context", EliasFano.build(contexts)), **succinct.named("pointer", EliasFano.build(pointer)),
            **succinct.named("value", EliasFano.build(word + np.repeat(base, np.diff(pointer)))),
        )
        succinct.save(folder, f"counts/{s}", context=contexts, pointer=pointer, count=counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64))
        return pd.DataFrame({"shard": [s], "n": [[int((counts == c).sum()) for c in (1, 2, 3, 4)]]})

    made = _counted(texts, model.cuts, pairs).groupBy("shard").applyInPandas(level, "shard int, n array<long>").collect()  # five numbers a shard
    shards = sorted(r.shard for r in made)
    model.held = np.isin(np.arange(len(model.cuts)), shards)
    model.taken = discounts([sum(r.n[i] for r in made) for i in range(4)])
    # the least that can be left of a count, or be freed of a context, over the most frequent word
    model.least = float(np.log(min(*(c - model.taken[c] for c in (1, 2, 3)), *model.taken[1:]) / max(r.most for r in found)) - 1e-9)
    inner = {int(c) >> 32 for c in model.cuts if int(c) & 0xFFFFFFFF}

    def codes(batches):
        levels = opened(model)
        for s in (int(s) for b in batches for s in b["shard"]):
            a = succinct.load(folder, f"counts/{s}")
            contexts, pointer, counts = a["context"], a["pointer"], a["count"].astype(np.int64)
            n = levels.counts(contexts.astype(np.int64))
            taken = model.taken[np.minimum(counts, 3)]
            back = np.add.reduceat(taken, pointer[:-1]) / n
            succinct.save(folder, f"codes/{s}", code=coded(np.log((counts - taken) / np.repeat(n, np.diff(pointer))), model.least, 256), back=coded(np.log(back), model.least, 65536))
            edge = [i for i in sorted({0, len(contexts) - 1}) if int(contexts[i]) in inner]
            yield pd.DataFrame({"shard": s, "context": contexts[edge].astype(np.int64), "back": back[edge]})

    rows = spark.createDataFrame([(s,) for s in shards], "shard int").repartition(min(len(shards), 4 * spark.sparkContext.defaultParallelism), "shard")
    weight: dict[int, list[tuple[int, float]]] = {}
    for r in rows.mapInPandas(codes, "shard int, context long, back double").collect():  # two rows a cut
        weight.setdefault(r.context, []).append((r.shard, r.back))
    model.split = {c: sum(g for _, g in sorted(x)) for c, x in sorted(weight.items())}
    drop(spark, f"{folder}/counts")
    expire(spark, folder)
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, n_known, train_tokens, base_score and score of each whole text."""
    held = df.sparkSession.sparkContext.broadcast(model)  # sizes and cuts of the shards only
    long, double = T.LongType(), T.DoubleType()

    def make():
        m, memo = held.value, Memo()
        levels = opened(m)

        def of(texts: pa.Array) -> list[pa.Array]:
            flat, size = tokens(texts, memo)
            own, back = np.unique(flat, return_inverse=True)
            ids, counts = levels.ids(own) if m.words else (np.full(len(own), -1), np.zeros(len(own), np.int64))
            plain = (counts + 1) * m.unseen
            now = ids[back]
            end = levels.ids(np.array([END]))[0] if m.words else np.array([-1])
            before = np.concatenate([end, now[:-1]])
            p = plain[back].copy()
            known = before >= 0
            if known.any():
                contexts, at = np.unique(before[known], return_inverse=True)
                p[known] *= levels.back(contexts)[at]
                both = known & (now >= 0)
                pairs, at = np.unique((before[both].astype(U64) << U64(32)) | now[both].astype(U64), return_inverse=True)
                p[both] += levels.seen(pairs)[at]
            begin = np.cumsum(size) - size
            add = lambda x: np.add.reduceat(x, begin) if len(begin) else x[:0]
            return [
                pa.array(size), pa.array(add((counts > 0).astype(np.int64)[back])), pa.array(np.full(len(size), m.tokens, np.int64)),
                pa.array(add(np.log10(plain)[back])), pa.array(add(np.log10(p))),
            ]

        return of

    return add_columns(df, text, [T.StructField(n, t) for n, t in (("n_tokens", long), ("n_known", long), ("train_tokens", long), ("base_score", double), ("score", double))], make, SLICE_BYTES)
