"""Token ids in ORC files: stripes of run-length coded integers, a row index, and a Bloom filter on the document ids.

Documents are range partitioned by id, so each file holds a run of ids in ascending
order and the stripes' statistics prune reads by id; the Bloom filter serves point
reads. A row is (doc_id, part, offset, size, ids): ``part`` numbers the files' ranges in
order, ``offset`` counts the ids before the row within its part, and ``size`` its own. The
start of a document in the whole corpus is then its part's start plus its offset, which
takes one row a part, no sort, and no reading of the ids.

The ids are those of the tokenizers library. Texts are cut at places that no
pre-token crosses (see ``bpe``), and the library encodes each different chunk once.

Nulls: a null text is empty, so it holds the end id alone; null doc_ids come first.
Equal doc_ids are ordered by their text and keep a row each. Columns other than the id
and the text are not written. An empty table gives no rows. Very long texts are one
row; the reader's tasks are dealt by stripe.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.llm import bpe
from sparrowlake.llm.common import expire, new_path, slices

#: Punctuation that is a pre-token of its own after a letter and before a space.
ENDS = ".,;:!?"
IDS = T.ArrayType(T.IntegerType())
#: Of text in a slice: a word that comes again in it is looked up once.
SLICE_BYTES = 8 << 20
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}


@lru_cache(maxsize=2)
def library_encoder(path: str) -> bpe.BlockEncoder:
    """Encodes chunks with the tokenizers library, without truncation or padding; one a worker process."""
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}

    plain, tokenize, of_end = dict(enumerate(bpe.byte_symbols())), t.model.tokenize, {c: t.token_to_id(c) for c in ENDS}

    def encode_chunks(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        upto = [0]  # where each chunk's ids end, those of ``whole`` chunks apart
        whole = []
        for i, c in enumerate(chunks):
            first, end = c[:1], None
            body = c[1:] if first == " " else c
            if body[-1:] in of_end and len(body) > 1:
                end = body[-1]
                body, c = body[:-1], c[:-1]
            if not body.isalpha():
                whole.append(i)
            elif c.isascii():  # one pre-token of letters, and one of punctuation: straight to the library's model
                ids += [x.id for x in tokenize("\u0120" + body if first == " " else c)]
                if end:
                    ids.append(of_end[end])
            elif max(body) < "\u0250":
                ids += [x.id for x in tokenize(c.encode().decode("latin-1").translate(plain))]
                if end:
                    ids.append(of_end[end])
            else:
                whole.append(i)
            upto.append(len(ids))
        ends = np.array(upto, np.int64)
        if not whole:
            return np.array(ids, np.int32), np.diff(ends)
        start, counts = ends[:-1].copy(), np.diff(ends)
        for i in range(0, len(whole), 50_000):
            for j, e in zip(whole[i : i + 50_000], t.encode_batch_fast([chunks[j] for j in whole[i : i + 50_000]], add_special_tokens=False)):
                found = e.ids
                start[j], counts[j] = len(ids), len(found)
                ids += found
        return bpe.gather(np.array(ids, np.int32), start, counts, np.arange(len(chunks))), counts

    return bpe.BlockEncoder(encode_chunks, special, re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None, memo_chunks=250_000)


def write(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, **options: str) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``doc_id``; ``options`` go before OPTIONS."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        enc, part, before = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in (x for batch in batches for x in slices(batch, 1, SLICE_BYTES)):
            ids, sizes = enc.encode_block(b.column(1))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            offsets = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(offsets), pa.array(sizes, pa.int64()), bpe.id_lists(ids, sizes)], names=["doc_id", "part", "offset", "size", "ids"])

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("ids", IDS)])
    ordered.mapInArrow(run, schema).write.options(**OPTIONS | options).orc(path)


def read(spark: SparkSession, path: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """Rows of the files with each document's ``start`` in the corpus: doc_id, start, ids, offset, part."""
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("ids", IDS)])
    rows = spark.read.schema(schema).orc(path)
    # one row a part, and a part is what one write task made: the bound of this broadcast is the number of tasks
    parts = rows.groupBy("part").agg(F.max(F.col("offset") + F.col("size")).alias("total")).selectExpr("part", "sum(total) OVER (ORDER BY part) - total AS part_start")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("part_start") + F.col("offset")).alias("start"), "ids", "offset", "part")


def crc32_of_ids(df: DataFrame, ids: str = "ids") -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids_crc32`` (unsigned, of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    kept = [c for c in df.columns if c != ids]

    def run(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=[*kept, "n_tokens", "ids_crc32"])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    path = new_path(df.sparkSession, "token-orc")
    write(df, path, tokenizer)
    expire(df.sparkSession, path)
    return read(df.sparkSession, path, df.schema["doc_id"].dataType)
