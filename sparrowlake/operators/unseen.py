"""A user's best unseen items by the similar ones of their own, added up without a shuffle of a row a (user, similar item).

An item's users and its similar items make one row. Users are hashed to blocks of about
``pairing.BLOCK_PAIRS`` (user, similar item). For each block a task packs the items that
its users have, each with its users there and its similar items once; the block's task
unpacks them, adds up what each user gets from all items, takes out what the user has,
and keeps the best. Blocks go in waves, as those of ``pairing`` do, and every wave reads all rows.

Users, items and similar items are whole numbers without nulls, items within
``pairing.MOST_SPAN``, and no number is missing; else ``top`` gives None.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.operators import pairing
from sparrowlake.operators.pairing import _coded, _cut, _mixed, _packed, _planes, _unplanes, ranges

#: An item of more users has several rows. Bytes of a packed similar item, as a bound.
MANY_USERS, PACKED_BYTES = 20_000, 6
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _lists(batch: pa.RecordBatch, of: int, *columns: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Where each list of column ``of`` begins, how long it is, and the entries of it and of ``columns``."""
    size = np.diff(batch.column(of).offsets.to_numpy()).astype(np.int64)
    return np.cumsum(size) - size, size, [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (of, *columns)]


def _deal(blocks: int, waves: int, wave: int, lo: int, first_user: int) -> Callable:
    """Packed rows (item, users, ratings, similar items in order, similarities) for the blocks of a wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_numpy() - lo
            _, many, (users, ratings) = _lists(batch, 1, 2)
            begin, size, (near, sims) = _lists(batch, 3, 4)
            near, (values, code) = near - lo, np.unique(sims, return_inverse=True)
            block = (_mixed(users) % np.uint64(blocks)).astype(np.int64)
            own = np.flatnonzero(block % waves == wave)
            own = own[np.argsort(block[own], kind="stable")]
            row, edges, rows = np.repeat(np.arange(len(many)), many)[own], _cut(block[own]), []
            for i, j in zip(edges, edges[1:]):
                at = np.flatnonzero(np.append(True, row[i + 1 : j] != row[i : j - 1]))
                r = row[i:j][at]
                length = size[r]
                entry = ranges(begin[r], length)
                gap, heads = np.diff(near[entry], prepend=0), (np.cumsum(length) - length)[length > 0]
                gap[heads] = near[entry[heads]]
                c = code[entry]
                used = np.flatnonzero(np.bincount(c, minlength=len(values)))
                small = np.zeros(len(values), np.int64)
                small[used] = np.arange(len(used))
                few, rated = _coded(ratings[own[i:j]])
                data = pickle.dumps((_planes(np.diff(np.append(at, j - i))), _planes(length), _planes(items[r]), _planes(users[own[i:j]] - first_user), (few, rated.tobytes()), _planes(gap), values[used], _planes(small[c])))
                rows.append((int(block[own[i]]), len(data), pa.compress(data, "zstd", asbytes=True)))
                if sum(len(x[2]) for x in rows) > 8 << 20:
                    yield _packed(rows)
                    rows = []
            if rows:
                yield _packed(rows)

    return run


class _Block:
    """What the users of a block have, and the sums of what is similar to it; one column (the similarities) if ``plain``."""

    def __init__(self, span: int, plain: bool) -> None:
        self.span, self.plain, self.sums = span, plain, pairing.Sums(lambda a, b: [])
        self.number: dict[int, int] = {}  # of each user
        self.seen: list[np.ndarray] = []
        self.parts: list = []
        self.held = 0

    def add(self, data: bytes) -> None:
        many, length, items, users, (few, rated), gap, values, code = pickle.loads(data)
        many, length, items, users, gap, code = (_unplanes(*x).astype(np.int64) for x in (many, length, items, users, gap, code))
        rated = np.frombuffer(rated, np.float64) if few is None else few[np.frombuffer(rated, np.uint8)]
        begin, sims, total = np.cumsum(length) - length, values[code], np.cumsum(gap)
        own = begin[length > 0]
        near = total - np.repeat(total[own] - gap[own], length[length > 0])
        distinct, at = np.unique(users, return_inverse=True)
        key = np.fromiter((self.number.setdefault(u, len(self.number)) for u in distinct.tolist()), np.int64, len(distinct))[at] * self.span
        row = np.repeat(np.arange(len(many)), many)
        self.seen.append(key + items[row])
        edges = _cut(np.cumsum(length[row]) // pairing.CHUNK)
        for i, j in zip(edges, edges[1:]):
            entry, size = ranges(begin[row[i:j]], length[row[i:j]]), length[row[i:j]]
            s = sims[entry]
            self.parts.append((np.repeat(key[i:j], size) + near[entry], None, [s] if self.plain else [s * np.repeat(rated[i:j], size), np.abs(s)]))
            self.held += len(entry)
            if self.held > pairing.MOST_PAIRS:
                self.parts = [pairing.merged(self.parts, self.sums)]
                self.held = len(self.parts[0][0]) // 2

    def best(self, k: int) -> list[np.ndarray]:
        """User (less the first one), rank, item (less the first one), score and sum of similarities."""
        key, _, columns = pairing.merged(self.parts, self.sums)
        seen = np.unique(np.concatenate(self.seen))
        ok, at = columns[-1] > 0, np.searchsorted(key, seen)
        hit = at < len(key)
        hit[hit] = key[at[hit]] == seen[hit]
        ok[at[hit]] = False
        key, columns = key[ok], [c[ok] for c in columns]
        rounded = lambda x: np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6
        total = order = rounded(columns[-1])
        score = np.ones(len(key)) if self.plain else rounded(columns[0] / columns[-1])
        if not self.plain:  # places in the order of score and sum, equal where both are
            by = np.lexsort((total, score))
            order = np.zeros(len(key), np.int64)
            order[by] = np.cumsum(np.append(0, (score[by][1:] != score[by][:-1]) | (total[by][1:] != total[by][:-1])))[: len(key)]
        at, rank = pairing.firsts(order, _cut(key // self.span), k)
        users = np.fromiter(self.number, np.int64, len(self.number))
        return [users[key[at] // self.span], rank.astype(np.int32), key[at] % self.span, score[at], total[at]]


def _sum(span: int, plain: bool, lo: int, first_user: int, k: int, schema: pa.Schema) -> Callable:
    """The best of the blocks whose packed rows come in the blocks' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None

        def done() -> pa.RecordBatch:
            u, rank, item, score, total = block.best(k)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((u + first_user, rank, item + lo, score, total), schema)], schema=schema)

        for batch in batches:
            for n, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if n != now:
                    if block:
                        yield done()
                    now, block = n, _Block(span, plain)
                block.add(pa.decompress(data.as_buffer(), size, "zstd", asbytes=True))
        if block:
            yield done()

    return run


def _by_item(history: DataFrame, sim: DataFrame) -> DataFrame:
    """item_i, its users and ratings (``MANY_USERS`` or so a row), its similar items in order and their similarities."""
    popular = history.groupBy("i").agg(F.expr(f"count(*) DIV {MANY_USERS} + 1").alias("parts")).where("parts > 1")
    if popular.isEmpty():
        dealt, part = history, F.lit(0)
    else:
        dealt, part = history.join(popular, "i", "left"), F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1)))
    users = dealt.groupBy("i", part.alias("part")).agg(F.collect_list(F.struct("u", "r")).alias("e"))
    near = sim.groupBy("item_i").agg(F.sort_array(F.collect_list(F.struct("item_j", "sim"))).alias("n"))
    x = users.join(near, F.col("i") == F.col("item_i"), "left")
    return x.select("i", F.col("e.u").alias("u"), F.col("e.r").alias("r"), F.coalesce("n.item_j", F.array().cast("array<bigint>")).alias("j"), F.coalesce("n.sim", F.array().cast("array<double>")).alias("s"))


def top(history: DataFrame, sim: DataFrame, k: int) -> DataFrame | None:
    """u, rank, item_id, score, sim_sum as ``itemcf.top_unseen`` has them; ``history`` is a written table of u, i, r."""
    kinds = [history.schema["u"].dataType, history.schema["i"].dataType]
    if not all(isinstance(t, WHOLE) for t in (*kinds, sim.schema["item_i"].dataType, sim.schema["item_j"].dataType)):
        return None
    long = lambda c: F.col(c).cast("long").alias(c)
    history = history.select(long("u"), long("i"), F.col("r").cast("double").alias("r"))
    sim = sim.where("sim IS NOT NULL").select(long("item_i"), long("item_j"), F.col("sim").cast("double").alias("sim"))
    a = history.agg(*(f(c).alias(n + c) for c in ("u", "i", "r") for n, f in (("lo_", F.min), ("hi_", F.max))), F.bool_or(F.expr("u IS NULL OR i IS NULL OR r IS NULL OR isnan(r)")).alias("odd")).first()
    b = sim.agg(F.min("item_j").alias("lo"), F.max("item_j").alias("hi"), F.min("sim").alias("least"), F.bool_or(F.expr("item_j IS NULL OR isnan(sim)")).alias("odd")).first()
    fields = [("u", T.LongType()), ("rank", T.IntegerType()), ("item_id", T.LongType()), ("score", T.DoubleType()), ("sim_sum", T.DoubleType())]
    schema = T.StructType([T.StructField(c, t) for c, t in fields])
    out = lambda df: df.select(F.col("u").cast(kinds[0]).alias("u"), "rank", F.col("item_id").cast(kinds[1]).alias("item_id"), "score", "sim_sum")
    if a.odd is None or b.odd is None:
        return out(history.sparkSession.createDataFrame([], schema))
    lo = min(a.lo_i, b.lo)
    span = max(a.hi_i, b.hi) - lo + 1
    if a.odd or b.odd or span > pairing.MOST_SPAN or a.hi_u - a.lo_u >= 1 << 62:
        return None
    items = pairing.stage(iter([_by_item(history, sim)]), "items")
    pairing.let_go(history.sparkSession)
    size = lambda c: F.size(c).cast("long")
    n, pairs = items.agg(F.sum(size("u")), F.sum(size("u") * size("j"))).first()
    waves = max(1, -(-int(pairs * PACKED_BYTES + n * 4) // max(pairing.LEAST_WAVE, pairing.WAVE_BYTES * n)))
    blocks = waves * max(1, -(-int(pairs + n) // (pairing.BLOCK_PAIRS * waves)))
    from pyspark.sql.pandas.types import to_arrow_schema

    end = _sum(span, a.lo_r == a.hi_r == 1 and b.least >= 0, lo, a.lo_u, k, to_arrow_schema(schema))
    wave = lambda w: out(items.mapInArrow(_deal(blocks, waves, w, lo, a.lo_u), pairing.PACKED).repartition(blocks // waves, "block").sortWithinPartitions("block").mapInArrow(end, schema))
    found = pairing.stage(map(wave, range(waves)), "unseen")
    pairing.drop(items)
    return found
