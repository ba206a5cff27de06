"""Pairs of items within users' lists, added up without a shuffle of a row a pair.

Items are hashed to blocks of about ``BLOCK_PAIRS`` pairs. For each block a task packs the
lists of the users that have one of its items: gaps between sorted items, byte by byte,
and their numbers, compressed, so a pair takes a few bytes on the way. The block's task
unpacks them, makes the pairs ``CHUNK`` at a time, sorts and adds them up in numpy, and
keeps what is asked for: the best of each item, or the lines of each pair.

Blocks go in waves, each written before the next, so that what lies in the shuffle at
once is about ``WAVE_BYTES`` for each (user, item), however many pairs there are; the
shuffle files of a wave are let go when the driver's garbage is collected after it, and
the table of lists after the last one. Every wave reads all lists.
"""

from __future__ import annotations

import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_PAIRS, CHUNK, MOST_PAIRS = 2_000_000, 1_000_000, 4_000_000
#: Of the shuffle in one wave, for each (user, item); a wave has LEAST_WAVE at least.
WAVE_BYTES, LEAST_WAVE = 24, 256 << 20
#: A pair of items is one 64-bit key, so items have to lie within this span.
MOST_SPAN = 3_000_000_000
#: Packed lists that are not dealt in waves: bytes for each (user, item), and tasks that take them at least, a block each or more.
ONCE_BYTES, TASKS = 64, 200
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparrowlake-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def let_go(spark: SparkSession) -> None:
    """Collect garbage, so that Spark removes the shuffle files that no plan needs any more; the first time only ends what the last query's plan is held by."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stage(frames: Iterator[DataFrame], tag: str) -> DataFrame:
    """Write frames of one schema one after the other and read them as one table, which goes when it is dropped or the driver ends."""
    path, schema, spark = None, None, None
    for df in frames:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{_shared(spark)}/sparrowlake/{tag}-{uuid.uuid4().hex}"
            fs, at = _place(spark, path)
            fs.deleteOnExit(at)
        df.write.mode("append").parquet(path)
        del df
        let_go(spark)
    table = spark.read.schema(schema).parquet(path)
    table._written_at = path
    return table


def written(df: DataFrame) -> bool:
    """Whether ``df`` is a table that ``stage`` wrote, so it needs nothing else."""
    return hasattr(df, "_written_at")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table of ``stage``; itself if it is one."""
    return df if written(df) else stage(iter([df]), tag)


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``stage`` that nothing reads any more; other frames are left alone."""
    for t in tables:
        if written(t):
            fs, at = _place(t.sparkSession, t._written_at)
            fs.delete(at, True)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _cut(n: np.ndarray) -> list[int]:
    """Where a sorted array changes, with both ends."""
    return [0, *(np.flatnonzero(n[1:] != n[:-1]) + 1).tolist(), len(n)] if len(n) else [0]


def _planes(x: np.ndarray) -> tuple[str, bytes]:
    """The numbers in the fewest bytes, their first bytes together, then the second ones, and so on."""
    kind = "<u4" if not len(x) or int(x.max()) < 1 << 32 else "<u8"
    return kind, np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(kind: str, data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _coded(column: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """A column as (distinct values, bytes) if it has 256 values at most, else as it is."""
    few = np.unique(column[:4096])
    if len(few) <= 256:
        few, code = np.unique(column, return_inverse=True)
        if len(few) <= 256:
            return few, code.astype(np.uint8)
    return None, column


def _deal(blocks: int, waves: int, wave: int, lo: int, halved: bool) -> Callable:
    """Packed lists for the blocks of a wave: list columns are the items, in order, and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            items = lists.flatten().to_numpy(zero_copy_only=False) - lo
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            begin = np.cumsum(size) - size
            numbers = [_coded(batch.column(k).flatten().to_numpy(zero_copy_only=False)) for k in range(1, batch.num_columns)]
            block = (_mixed(items) % np.uint64(blocks)).astype(np.int64)
            own = np.flatnonzero(block % waves == wave)
            user = np.repeat(np.arange(len(size)), size)[own]
            order = np.argsort(user * blocks + block[own], kind="stable")
            own, user = own[order], user[order]
            first = np.append(True, (user[1:] != user[:-1]) | (block[own[1:]] != block[own[:-1]])) if len(own) else np.zeros(0, bool)
            edges = _cut(np.cumsum(np.where(first, size[user], 0)) // CHUNK)
            rows = []
            for i, j in zip(edges, edges[1:]):
                by = np.argsort(block[own[i:j]], kind="stable")
                o, u = own[i:j][by], user[i:j][by]
                b = block[o]
                at = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (b[1:] != b[:-1])))
                many = np.diff(np.append(at, len(o)))
                start = o[at] if halved else begin[u[at]]
                length = begin[u[at]] + size[u[at]] - start
                place = o - np.repeat(start, many)
                ends, cuts = np.cumsum(length), _cut(b[at])
                for g, h in zip(cuts, cuts[1:]):
                    entry = ranges(start[g:h], length[g:h])
                    gap = np.diff(items[entry], prepend=0)
                    heads = ends[g:h] - length[g:h] - (ends[g] - length[g])
                    gap[heads] = items[entry[heads]]
                    mine = slice(at[g], at[h] if h < len(at) else len(o))
                    data = pickle.dumps((_planes(many[g:h]), _planes(length[g:h]), _planes(place[mine]), _planes(gap), [(v, c[entry].tobytes()) for v, c in numbers]))
                    rows.append((int(b[at[g]]), len(data), pa.compress(data, "zstd", asbytes=True)))
                if sum(len(r[2]) for r in rows) > 8 << 20:
                    yield _packed(rows)
                    rows = []
            if rows:
                yield _packed(rows)

    return run


PACKED = "block long, size long, data binary"


def _packed(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["block", "size", "data"])


def _pairs(data: bytes, span: int, halved: bool) -> Iterator[tuple[np.ndarray, list, list]]:
    """Keys of pairs and the numbers of both items, CHUNK pairs at a time."""
    many, length, place, gap, numbers = pickle.loads(data)
    many, length, place, gap = (_unplanes(*x).astype(np.int64) for x in (many, length, place, gap))
    begin = np.cumsum(length) - length
    total = np.cumsum(gap)
    items = total - np.repeat(total[begin] - gap[begin], length)
    numbers = [np.frombuffer(c, np.float64) if v is None else v[np.frombuffer(c, np.uint8)] for v, c in numbers]
    group = np.repeat(np.arange(len(many)), many)
    own = begin[group] + place
    start = own + 1 if halved else begin[group]
    size = begin[group] + length[group] - start
    edges = _cut(np.cumsum(size) // CHUNK)
    for i, j in zip(edges, edges[1:]):
        a, b = np.repeat(own[i:j], size[i:j]), ranges(start[i:j], size[i:j])
        if not halved:
            other = a != b
            a, b = a[other], b[other]
        yield items[a] * span + items[b], [c[a] for c in numbers], [c[b] for c in numbers]


class Sums:
    """What is kept of a pair: its number of users, and columns that are added up or the same each time (``first``)."""

    def __init__(self, of: Callable[[list, list], list[np.ndarray]], first: tuple[int, ...] = ()) -> None:
        self.of, self.first = of, first

    def single(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        return columns

    def merge(self, n: np.ndarray, columns: list[np.ndarray], at: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
        return [c[at] if k in self.first else np.add.reduceat(c, at) for k, c in enumerate(columns)]


class Lines(Sums):
    """Means, squares and products about them, and the least and largest a, of pairs of ratings (a, b); parts are put together by Chan's rule."""

    def __init__(self) -> None:
        super().__init__(lambda a, b: [a[0], b[0]])

    def single(self, columns):
        a, b = columns
        return [a, b, np.zeros(len(a)), np.zeros(len(a)), a, a]

    def merge(self, n, columns, at, total):
        a, b, aa, ab, low, high = columns
        ma, mb = (np.add.reduceat(n * c, at) / total for c in (a, b))
        size = np.diff(np.append(at, len(n)))
        da, db = a - np.repeat(ma, size), b - np.repeat(mb, size)
        return [ma, mb, np.add.reduceat(aa + n * da * da, at), np.add.reduceat(ab + n * da * db, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)]


class Products(Sums):
    """Sums of ab, aa and bb."""

    def __init__(self) -> None:
        super().__init__(lambda a, b: [a[0], b[0]])

    def single(self, columns):
        a, b = columns
        return [a * b, a * a, b * b]


def merged(parts: list, sums: Sums, least: int = 1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Parts (keys, numbers of users or None for one each, columns) as one, in the keys' order; pairs of fewer than ``least`` users are left out."""
    key = np.concatenate([p[0] for p in parts])
    raw = all(p[1] is None for p in parts)
    if not raw:
        parts = [(k, np.ones(len(k), np.int64), sums.single(c)) if n is None else (k, n, c) for k, n, c in parts]
    n = None if raw else np.concatenate([p[1] for p in parts])
    columns = [np.concatenate(c) for c in zip(*(p[2] for p in parts))]
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(key)))
    total = size if raw else np.add.reduceat(n[order], at) if len(key) else size
    if least > 1:
        enough = total >= least
        kept = np.repeat(enough, size)
        key, order, size, total = key[kept], order[kept], size[enough], total[enough]
        at = np.cumsum(size) - size
    columns = [c[order] for c in columns]
    if not len(key):
        return key, total, [c[:0] for c in (sums.single(columns) if raw else columns)]
    if raw:
        columns = sums.single(columns)
    return key[at], total, sums.merge(np.ones(len(order), np.int64) if raw else n[order], columns, at, total)


def best(key: np.ndarray, sim: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and ranks of the k largest of each first item, ties (to 9 decimals) to the smaller second one; keys are in order."""
    q = (np.sign(sim) * np.floor(np.abs(sim) * 1e9 + 0.5)).astype(np.int64)
    return firsts(q, _cut(key // span), k)


def firsts(order: np.ndarray, edges: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and ranks of the k largest between each two edges, ties to the earlier place."""
    at, rank = [], []
    for i, j in zip(edges, edges[1:]):
        x = order[i:j]
        found = np.flatnonzero(x >= np.partition(x, j - i - k)[j - i - k]) if j - i > k else np.arange(j - i)
        found = found[np.argsort(-x[found], kind="stable")[:k]]
        at.append(found + i)
        rank.append(np.arange(1, len(found) + 1))
    return (np.concatenate(at), np.concatenate(rank)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _meet(sums: Sums, span: int, lo: int, halved: bool, least: int, finish: Callable, schema: pa.Schema) -> Callable:
    """Results of the blocks whose packed lists come in the blocks' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []

        def done():
            key, n, columns = merged(parts, sums, least)
            out = finish(key, n, columns)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([out[0] // span + lo, out[0] % span + lo, *out[1:]], schema)], schema=schema)

        block, held = None, 0
        for batch in batches:
            for now, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now != block:
                    if parts:
                        yield done()
                    block, held, parts = now, 0, []
                for key, a, b in _pairs(pa.decompress(data.as_buffer(), size, "zstd", asbytes=True), span, halved):
                    parts.append((key, None, sums.of(a, b)))
                    held += len(key)
                    if held > MOST_PAIRS:
                        parts = [merged(parts, sums)]
                        held = len(parts[0][0]) // 2  # so that merging goes on to pay where pairs are many and distinct
        if parts:
            yield done()

    return run


def _lists(x: DataFrame, columns: list[str]) -> DataFrame:
    """A written row of sorted items, and their columns, for each user with two items or more."""
    let_go(x.sparkSession)  # of what wrote x
    listed = x.select("u", F.struct(F.col("i").cast("long").alias("i"), *(F.col(c).cast("double").alias(c) for c in columns)).alias("e")).groupBy("u").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return stage(iter([listed.where(F.size("e") > 1).select(*(F.col(f"e.{c}").alias(c) for c in ("i", *columns)))]), "lists")


def meet(x: DataFrame, columns: list[str], sums: Sums, finish: Callable, fields: list[tuple[str, T.DataType]], least: int = 1, halved: bool = False, wide: int = 0) -> DataFrame | None:
    """item_i, item_j and ``fields``: what ``finish(keys, n, columns, span)`` keeps of a block's pairs.

    ``x`` has distinct (u, i) and numeric ``columns``. ``halved``: item_i < item_j only, else both directions. ``wide``:
    how many columns have too many values for a byte each. None if the items are not whole numbers or
    lie too far apart, or a number is missing.
    """
    kind = x.schema["i"].dataType
    if not isinstance(kind, WHOLE):
        return None
    lists = _lists(x, columns)
    size = F.size("i").cast("double")
    facts = lists.agg(F.sum(size).alias("n"), F.sum(size * size).alias("pairs"), F.min(F.element_at("i", 1)).alias("lo"), F.max(F.element_at("i", -1)).alias("hi"), *(F.max(F.exists(c, lambda v: v.isNull() | F.isnan(v))).alias(f"no_{c}") for c in columns)).first()
    schema = T.StructType([T.StructField("item_i", T.LongType()), T.StructField("item_j", T.LongType()), *(T.StructField(c, t) for c, t in fields)])
    out = lambda df: df.select(F.col("item_i").cast(kind).alias("item_i"), F.col("item_j").cast(kind).alias("item_j"), *(c for c, _ in fields))
    if facts.n is None:
        drop(lists)
        return out(x.sparkSession.createDataFrame([], schema))
    lo, span = facts.lo, facts.hi - facts.lo + 1
    if span > MOST_SPAN or any(facts[f"no_{c}"] for c in columns):
        drop(lists)
        return None
    waves = max(1, -(-int(facts.pairs * (3 + len(columns) + 7 * wide)) // max(LEAST_WAVE, int(WAVE_BYTES * facts.n))))
    blocks = waves * max(1, -(-int(facts.pairs) // (BLOCK_PAIRS * waves)))
    from pyspark.sql.pandas.types import to_arrow_schema

    end = _meet(sums, span, lo, halved, least, lambda *a: finish(*a, span), to_arrow_schema(schema))
    wave = lambda w: out(lists.mapInArrow(_deal(blocks, waves, w, lo, halved), PACKED).repartition(blocks // waves, "block").sortWithinPartitions("block").mapInArrow(end, schema))
    found = stage(map(wave, range(waves)), "pairs")
    drop(lists)
    return found


def listed(x: DataFrame) -> DataFrame | None:
    """The table of lists that ``counted`` takes; None if the items are not whole numbers."""
    return _lists(x, []) if isinstance(x.schema["i"].dataType, WHOLE) else None


def counted(lists: list[DataFrame], kind: T.DataType) -> DataFrame | None:
    """item_i < item_j and together: in how many lists of the tables both are. The result is lazy and reads the tables.

    Whole results are as long as the pairs, so they are not written here: where the packed lists of all blocks take
    ``ONCE_BYTES`` at most for each entry of a list, they go to the blocks in one pass, and the blocks' tasks hand the pairs
    on. Longer lists take waves, which are written. None if the items lie too far apart.
    """
    whole = lists[0]
    for t in lists[1:]:
        whole = whole.unionByName(t)
    size = F.size("i").cast("double")
    facts = whole.agg(F.sum(size).alias("n"), F.sum(size * (size - 1) / 2).alias("pairs"), F.min(F.element_at("i", 1)).alias("lo"), F.max(F.element_at("i", -1)).alias("hi")).first()
    schema = T.StructType([T.StructField("item_i", T.LongType()), T.StructField("item_j", T.LongType()), T.StructField("together", T.LongType())])
    out = lambda df: df.select(F.col("item_i").cast(kind).alias("item_i"), F.col("item_j").cast(kind).alias("item_j"), "together")
    if facts.n is None:
        return out(whole.sparkSession.createDataFrame([], schema))
    lo, span = facts.lo, facts.hi - facts.lo + 1
    if span > MOST_SPAN:
        return None
    once = facts.pairs * 2 <= max(LEAST_WAVE, ONCE_BYTES * facts.n)
    waves = 1 if once else -(-int(facts.pairs * 2) // max(LEAST_WAVE, int(WAVE_BYTES * facts.n)))
    blocks = waves * max(1, -(-int(facts.pairs) // (BLOCK_PAIRS * waves)))
    from pyspark.sql.pandas.types import to_arrow_schema

    end = _meet(Sums(lambda a, b: []), span, lo, True, 1, lambda key, n, of: [key, n], to_arrow_schema(schema))
    tasks = min(blocks // waves, max(TASKS, -(-blocks // waves // 16)))  # a task takes several blocks, one after the other
    wave = lambda w: out(whole.mapInArrow(_deal(blocks, waves, w, lo, True), PACKED).repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(end, schema))
    return wave(0) if once else stage(map(wave, range(waves)), "together")
