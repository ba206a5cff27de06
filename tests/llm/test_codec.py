import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")

from pyspark.sql import functions as F

from sparrowlake.llm import bpe, queries, sharding, token_orc

ODD = ["", "  a  b", "a<|endoftext|> b  <|endoftext|>", "x\x1c y \x85 z q's 'll\n\n  \t ok ", "aaaaaaaa" * 50, " \n", "é 한국어 日本 😀😀", "nul \x00 in it\nx", "a\nb c\n", "x" * 50_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_equal_the_library(library):
    random.seed(1)
    texts = ODD + ["".join(random.choice("ab 's\n\té한1½., \x1c") for _ in range(random.randint(0, 60))) for _ in range(400)]
    enc, lib = bpe.block_encoder(queries.tokenizer_path()), token_orc.library_encoder(queries.tokenizer_path())
    for t, a, b in zip(texts, enc.encode(texts), lib.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert a.tolist() == want == b.tolist()
        assert bpe.load(queries.tokenizer_path()).decode(want) == library.decode(want, skip_special_tokens=False)


def test_words_of_a_slice():
    """Hashes of words cut in Arrow against bytes.split() and lower()."""
    import pyarrow as pa

    from sparrowlake.llm.common import Memo, hashed_words, word_hashes

    random.seed(3)
    texts = [None, "", " ", "\t\n", "A b", " a\x0bB\x0cC\r\n ", "É é\x85x\x1cY\u2003z \0q"] + ["".join(random.choice("aBÉ \n\t\x0b\x1d\u00a0") for _ in range(random.randint(0, 40))) for _ in range(300)]
    for part in (texts, texts[:2], texts[4:5], []):
        flat, size = hashed_words(pa.array(part, pa.string()), Memo())
        want = [word_hashes((t or "").encode(), Memo()) for t in part]
        assert size.tolist() == [len(w) for w in want] and flat.tolist() == [h for w in want for h in w.tolist()]
    whole = pa.array(texts[1:], pa.string())  # without nulls a slice shares its buffers with the whole
    for i in (0, 1, 17, 250):
        part = [word_hashes(t.encode(), Memo()).tolist() for t in texts[1 + i : 41 + i]]
        flat, size = hashed_words(whole.slice(i, 40), Memo())
        assert size.tolist() == list(map(len, part)) and flat.tolist() == sum(part, [])


def test_encoders_on_slices(library):
    """Slices of one array, as batches are cut: their first text does not begin at the buffer's start."""
    import pyarrow as pa

    random.seed(4)
    texts = [" ".join("".join(random.choice("abÉ.") for _ in range(random.randint(1, 7))) for _ in range(random.randint(0, 30))) + random.choice(["", "\n", " <|endoftext|> ", "  x"]) for _ in range(60)]
    whole = pa.array(texts, pa.string())
    for enc in (bpe.block_encoder(queries.tokenizer_path()), token_orc.library_encoder(queries.tokenizer_path())):
        for i in (0, 1, 13, 40):
            ids, counts = enc.encode_block(whole.slice(i, 20))
            want = [library.encode(t, add_special_tokens=False).ids for t in texts[i : i + 20]]
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_two_generations_of_chunks(library):
    """Chunks that move between the generations, or are encoded again, keep their ids."""
    random.seed(2)
    held = bpe.block_encoder(queries.tokenizer_path()).memo.encode_chunks, token_orc.library_encoder(queries.tokenizer_path()).memo.encode_chunks
    words = ["".join(random.choice("abcéœ") for _ in range(random.randint(1, 6))) + random.choice(["", ".", ",", "?!", "'s", "…"]) for _ in range(300)] + ["ɐʘ", "1.", ".", "é.", "Ā,"]
    for encode_chunks in held:
        enc = bpe.BlockEncoder(encode_chunks, {}, None, memo_chunks=40)
        for _ in range(60):
            texts = [" ".join(random.choices(words, k=random.randint(0, 30))) for _ in range(3)]
            for t, x in zip(texts, enc.encode(texts)):
                assert x.tolist() == library.encode(t, add_special_tokens=False).ids
        assert enc.memo.old is not None and len(enc.memo) + len(enc.memo.old) < 200


def test_op3_over_documents(spark, sf, library):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    got = queries.op3(spark, sf).toPandas()
    assert len(got) == len(texts)
    for r in got.itertuples():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_codec_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (2, "a b", "y"), (2, "a b", "y")], "doc_id long, text string, IDS string")
    got = bpe.decode(bpe.encode(df, queries.tokenizer_path()), queries.tokenizer_path())
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id, r.ids, r.decoded) for r in got.collect()) == [(1, [], ""), (2, [], ""), (2, [64, 275], "a b"), (2, [64, 275], "a b")]
    assert bpe.encode(df.limit(0), queries.tokenizer_path()).count() == 0
    assert bpe.decode(spark.createDataFrame([([64, -1, 10**6, None],), (None,)], "ids array<int>"), queries.tokenizer_path()).collect()[0].decoded == "a"


def test_op8_over_documents(spark, sf, library):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    got, start = queries.op8(spark, sf).orderBy("doc_id").collect(), 0
    assert [r.doc_id for r in got] == sorted(texts)
    for r in got:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_orc_edges(spark):
    df = spark.createDataFrame([(2, "a", 1), (None, None, 2), (2, "a", 3), (1, "", 4)], "doc_id long, text string, part int")
    got = token_orc.crc32_of_ids(token_orc.round_trip(df, queries.tokenizer_path())).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 1), (1, 1, 1), (2, 2, 2), (2, 4, 2)]
    assert token_orc.round_trip(df.limit(0), queries.tokenizer_path()).count() == 0


def test_orc_stripes_index_and_bloom_filter(spark, tmp_path):
    """The footer names several stripes, each with a row index and a Bloom filter on doc_id; a point read skips stripes and rows."""
    path = str(tmp_path / "ids")
    rows = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.md5(F.col("id").cast("string")), F.lit(" ")), 6).alias("text")).coalesce(1)
    token_orc.write(rows, path, queries.tokenizer_path(), **{"orc.stripe.size": str(256 << 10)})
    jvm, found = spark._jvm, []
    for f in sorted(tmp_path.glob("ids/*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{f}"), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        records = reader.rows()
        for stripe in reader.getStripes():
            streams = [(s.getColumn(), s.getKind().toString()) for s in records.readStripeFooter(stripe).getStreamsList()]
            found.append({(c, k) for c, k in streams if k in ("ROW_INDEX", "BLOOM_FILTER_UTF8")})
    assert len(found) > len(list(tmp_path.glob("ids/*.orc"))) and all({(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8"), (4, "ROW_INDEX")} <= x and (2, "BLOOM_FILTER_UTF8") not in x for x in found)

    def scanned(condition):
        plan = spark.read.orc(path).where(condition)._jdf.queryExecution().executedPlan()
        n = len(plan.executeCollect())
        return n, plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    assert scanned("doc_id >= 0") == (20_000, 20_000)
    assert scanned("doc_id = 12346")[0] == 1 and scanned("doc_id = 12346")[1] <= 1000  # one row group
    assert scanned("doc_id = 12345") == (0, 0)  # inside the range, but not in the Bloom filter


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, 42)
    p = f.forward(np.arange(n, dtype=np.uint64))
    assert sorted(p.tolist()) == list(range(n)) and f.back(p).tolist() == list(range(n))


def test_op9_law(spark, sf):
    got = queries.op9(spark, sf).toPandas()
    d = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    counts = got.groupby("shard").size()
    assert len(got) == len(d) and counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    rank = {i: k for k, i in enumerate(sorted(d.index))}
    for r in got.itertuples():
        t = d[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        assert (r.shard, r.slot) == sharding.locate(rank[r.doc_id], len(d), 16, 42)
        assert sharding.row_at(r.shard, r.slot, len(d), 16, 42) == rank[r.doc_id]
    again = queries.op9(spark, sf).toPandas()
    assert sorted(again[["doc_id", "shard", "slot"]].itertuples(index=False, name=None)) == sorted(got[["doc_id", "shard", "slot"]].itertuples(index=False, name=None))


def test_shard_edges(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (1, "x"), (7, None)], "k long, Slot string")
    got = sharding.shard(df, ["k"], 3)
    assert got.columns == ["k", "row_number", "shard", "slot"] and sorted(r.row_number for r in got.collect()) == [0, 1, 2, 3]
    assert sharding.shard(df.limit(0), ["k"], 3).count() == 0
    assert got.select(F.countDistinct("shard", "slot")).first()[0] == 4


def test_token_orc_totals_read_no_ids(spark, tmp_path):
    """Where the parts begin comes from the sizes beside the ids."""
    from sparrowlake.llm import token_orc
    from sparrowlake.llm.queries import tokenizer_path

    token_orc.write(spark.createDataFrame([(i, "a few words " * i) for i in range(40)], "doc_id long, text string"), f"file://{tmp_path}/o", tokenizer_path())
    x = token_orc.read(spark, f"file://{tmp_path}/o")
    scans = [line for line in x._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert len(scans) == 2 and sum("ids:array" in s for s in scans) == 1
    rows = sorted(x.collect())
    assert [r.start for r in rows] == [sum(len(q.ids) for q in rows[:i]) for i in range(40)]
