"""What several operators share: stage tables, column hygiene, words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and all run on one machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster[")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparrowlake-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sparrowlake/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it again: later work starts from files that outlive any executor."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    expire(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def expire(spark: SparkSession, path: str) -> None:
    """Remove what a lazy result may still read when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove stage tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns whose names (in any case) an operator is about to add: the operator's columns replace them."""
    low = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def slices(batch: pa.RecordBatch, at: int, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (or bytes) in column ``at`` add up to about ``most`` bytes, so that memory follows bytes and not rows."""
    kind = batch.column(at).type
    if not (pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind)):
        yield batch
        return
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def add_columns(df: DataFrame, source: str, new: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], most: int = 3 << 20) -> DataFrame:
    """``df`` with Arrow columns computed from column ``source``, a slice of a batch at a time; ``make`` runs once a task and returns the function of a slice."""
    names = [f.name for f in new]
    if source.lower() in {n.lower() for n in names}:
        raise ValueError(f"{source} is read, so it can't be replaced")
    kept = without(df, names)
    at = kept.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for b in slices(batch, at, most):
                yield pa.RecordBatch.from_arrays([*b.columns, *f(b.column(at))], names=[*b.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new]))


def raw(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    binary = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(binary).to_pylist()]


class Memo(dict):
    """Hash of a word, kept for the words seen last; ``trim`` bounds its memory."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case (bytes.split() without an argument splits at just these)."""
    return text.lower().split()


def word_hashes(text: bytes, memo: Memo) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(memo.__getitem__, found), U64, len(found))


def hashed_words(texts: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after the other, and how many each has; a slice's distinct words are hashed once."""
    memo.trim()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = lists.offsets.to_numpy().astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    ends -= ends[0]
    found = lists.flatten().dictionary_encode()
    distinct = [w.lower() for w in found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]  # pc.ascii_lower misreads arrays whose first text is not at 0
    at = found.indices.to_numpy()
    hashes = np.fromiter(map(memo.__getitem__, distinct), U64, len(distinct))[at] if len(distinct) else np.zeros(0, U64)
    if (none := found.dictionary.index("").as_py()) >= 0:  # what white space at an end leaves
        kept = at != none
        hashes, ends = hashes[kept], np.concatenate([[0], np.cumsum(kept)])[ends]
    return hashes, np.diff(ends)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles, in order; of the whole sequence if it has fewer than k words; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.full(n - k + 1, k, U64)
    for j in range(k):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + hashes[j : n - k + 1 + j])
    return out
