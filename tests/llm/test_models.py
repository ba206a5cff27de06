import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowlake.llm import lm, queries, rules, succinct
from sparrowlake.llm.succinct import EliasFano


@pytest.mark.parametrize("n,top", [(1, 1), (5, 3), (1000, 10**6), (4000, 2**40), (3000, 2000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    assert (EliasFano.of(succinct.named("x", EliasFano.build(v)), "x").access(np.arange(n)) == v).all()
    v = np.unique(v)
    e = EliasFano.of(succinct.named("x", EliasFano.build(v)), "x")
    q = np.concatenate([v, rng.integers(0, top + 5, 500).astype(np.uint64)])
    at = np.minimum(np.searchsorted(v, q), len(v) - 1)
    want = np.where(v[at] == q, at, -1)
    a = rng.integers(0, len(v), len(q))
    b = np.minimum(len(v), a + rng.integers(0, 5, len(q)))
    assert (e.find(q, np.zeros(len(q), np.int64), np.full(len(q), len(v))) == want).all()
    assert (e.find(q, a, b) == np.where((want >= a) & (want < b), want, -1)).all()


def words(text):
    return [*(text or "").encode().lower().split(), b" end"]


def test_op2_base_and_gain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    train = Counter(w for d in docs if zlib.crc32(str(d.doc_id).encode()) % 7 != 2 for w in words(d.text))
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in queries.op2(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, w = got[d.doc_id], words(d.text)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in train for x in w), n)
        assert abs(r.base_score - sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_against_a_dictionary_model(spark, monkeypatch):
    """The trie's probabilities against counts in dictionaries, with contexts that are cut between shards; they add up to 1."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 200)
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{min(int(x), 300)}" for x in rng.zipf(1.3, 60))
    train = [text() for _ in range(120)] + [None, "", "a a a a"]
    model = lm.train(spark.createDataFrame([(t, 1) for t in train], "text string, n long").repartition(4))
    pairs, uni = Counter(), Counter()
    for t in train:
        w = words(t)
        uni.update(w)
        pairs.update(zip([b" end", *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    assert (model.tokens, model.words) == (n, v) and len(model.cuts) > 16 and len(model.split) > 0
    levels = lm.Levels(model)
    vocab = sorted(uni, key=lambda w: lm.END if w == b" end" else lm.xxhash.xxh3_64_intdigest(w))
    hashes = np.array([lm.END if w == b" end" else lm.xxhash.xxh3_64_intdigest(w) for w in vocab], np.uint64)
    ids, counts = levels.ids(hashes)
    assert ids.tolist() == list(range(v)) and counts.tolist() == [uni[w] for w in vocab]
    back = levels.back(ids)
    for c in (0, 5, int(ids[vocab.index(b" end")]), int(ids[vocab.index(b"w1")])):
        seen = levels.seen((np.uint64(c) << np.uint64(32)) | ids.astype(np.uint64))
        assert {vocab[i] for i in np.flatnonzero(seen)} == {b for a, b in pairs if a == vocab[c]}
        total = seen.sum() + back[c] * ((counts + 1) * model.unseen).sum() + back[c] * model.unseen
        assert abs(total - 1) < 0.02
    test = spark.createDataFrame([(1, None, "x"), (2, "w1 w1 nothing w2 w1", "x"), (2, text() * 50, "y")], "doc_id long, text string, Score string")
    got = lm.score(test, model)
    assert [c.lower() for c in got.columns].count("score") == 1
    r = {len(x.text or ""): x for x in got.collect()}
    assert r[0].n_tokens == 1 and r[19].n_known == 5 and all(x.score < 0 for x in r.values())
    assert lm.score(test.limit(0), model).count() == 0
    empty = lm.score(test, lm.train(test.limit(0))).collect()
    assert all(x.train_tokens == 0 and x.score == x.base_score == 0 for x in empty)


def test_op4_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op4(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good = [s for s, y in held if y]
    bad = [s for s, y in held if not y]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9, auc
    assert sum((s >= 0.5) == bool(y) for s, y in held) > 0.9 * len(held)


def test_rules_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "a b c\n" * 20_000, "c"), (None, "###", "d")], "doc_id long, text string, SCORE string")
    none = rules.learn(np.zeros((0, len(rules.STATS))), np.zeros(0))
    got = rules.classify(df, none)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and [r.score for r in got.collect()] == [0.5] * 4
    x = np.random.default_rng(0).normal(size=(400, len(rules.STATS)))
    learnt = rules.learn(x, ((x[:, 2] > 0) & (x[:, 4] < 1)).astype(float))
    assert 0 < len(learnt.rules) < 200 and all(c for c, _ in learnt.rules)
    assert len(rules.classify(df, learnt).collect()) == 4 and rules.classify(df.limit(0), learnt).count() == 0
    one = rules.learn(x, np.ones(400))
    assert not one.rules and rules.classify(df, one).first().score > 0.9
    p = 1 / (1 + np.exp(-(learnt.intercept + sum(w * rules._holds(x, c) for c, w in learnt.rules))))
    frame = spark.createDataFrame(x.tolist(), [f"_s_{s}" for s in rules.STATS])
    assert np.allclose(frame.select(rules.score(learnt).alias("s")).toPandas().s, p)


def test_pipeline_against_brute_force(spark, sf):
    from test_near_dup import brute
    from tests_llm_helpers import shingles

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id: r.text for r in rules.classify(docs, rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(queries.remainder("doc_id", 3) != 1))).where(F.col("score") >= corpus_pipeline.REJECT_BELOW).collect()}
    kept = {i for i, _, c in brute(sorted(good.items()), 5) if i == c}
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(100 * len(shingles(good[i], 5) & t) >= 80 * len(t) for t in items if t)}
    assert len(docs.collect()) > len(good) > len(kept) > len(clean)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(clean) and all(r.round_trip for r in got)


def test_pipeline_stages_with_odd_rows(spark, sf, tmp_path):
    rows = [(None, None, None, None, None), (None, "no id here", "en", "s", 1), (5, "twice the same row", "en", "s", 1), (5, "twice the same row", "en", "s", 1), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df, n in ((docs, 4), (docs.limit(0), 0)):
        out = corpus_pipeline.near_duplicates(spark, df, sf)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == n
        for _, f in corpus_pipeline.STAGES[2:]:
            out = f(spark, out, sf)
            assert out.count() == n


def test_quality_stage_follows_the_verdict(spark, tmp_path):
    """Few labels, most of them 0: every text scores as their share, which is over 0.1. op4 rejects them, and so does the stage."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 7) for i in range(18)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(18)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    learnt = rules.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").where(queries.remainder("doc_id", 3) != 1))
    assert all(0.1 <= r.score < 0.5 and r.predicted == 0 for r in rules.classify(docs, learnt).collect())
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == 0


def dictionary_model(train):
    """log10 probability of a text by counts in dictionaries: one set of modified Kneser-Ney discounts for the corpus."""
    pairs, uni = Counter(), Counter()
    for t in train:
        w = words(t)
        uni.update(w)
        pairs.update(zip([b" end", *w[:-1]], w))
    n = [max(1, sum(c == k for c in pairs.values())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0] + [min(max(c - (c + 1) * y * n[c] / n[c - 1], 0.05), c - 0.05) for c in (1, 2, 3)]
    back, unseen = Counter(), 1 / (sum(uni.values()) + len(uni) + 1)
    for (c, _), k in pairs.items():
        back[c] += d[min(k, 3)] / uni[c]

    def log10(t):
        w = words(t)
        return sum(math.log10((uni[x] + 1) * unseen * (back[c] if c in uni else 1.0) + ((pairs[c, x] - d[min(pairs[c, x], 3)]) / uni[c] if pairs[c, x] else 0.0)) for c, x in zip([b" end", *w[:-1]], w))

    return log10


def test_every_token_s_probability(spark, monkeypatch):
    """score() against counts in dictionaries, to the bound of the 8-bit codes, token by token: each text adds one token to another."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 200)
    rng = np.random.default_rng(6)
    text = lambda n=60: " ".join(f"w{min(int(x), 300)}" for x in rng.zipf(1.3, n))
    train = [text() for _ in range(120)] + [text(2000)] + ["again and again"] * 3
    frame = spark.createDataFrame([(t,) for t in train], "text string")
    model, log10 = lm.train(frame.repartition(4)), dictionary_model(train)
    assert len(model.split) > 1 and 0 < model.bound < 0.02
    long = text(300).split()
    test = ["", "w1 nothing w1 nothing", "again and again"] + [" ".join(long[:n]) for n in range(1, 301)]
    got = {r.text: r for r in lm.score(spark.createDataFrame([(t,) for t in test], "text string").repartition(8), model).collect()}
    for t in test:
        assert abs(got[t].score - log10(t)) <= model.bound * got[t].n_tokens * 1.001, t
    own = [abs(got[a].score - got[b].score - (log10(a) - log10(b))) for a, b in zip(test[4:], test[3:])]
    assert max(own) < 4 * model.bound  # the last word and the end


def test_one_model_whatever_the_partitions(spark, monkeypatch, sf):
    """Shuffle partitions, input partitions and workers that already hold levels change no score."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5000)
    docs, before, found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 32):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            model = lm.train(docs.repartition(n))
            for m in (1, n):  # the second time in workers that have scored
                found.append({r.doc_id: r.score for r in lm.score(docs.repartition(m), model).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(x.keys() == found[0].keys() and all(math.isclose(x[i], found[0][i], rel_tol=1e-12) for i in x) for x in found)


def test_op2_scores_of_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    log10 = dictionary_model([d.text for d in docs if zlib.crc32(str(d.doc_id).encode()) % 7 != 2])
    got = {r.doc_id: r for r in queries.op2(spark, sf).collect()}
    for d in docs:
        assert abs(got[d.doc_id].score - log10(d.text)) <= 0.02 * got[d.doc_id].n_tokens


def test_levels_on_another_file_system(tmp_path, monkeypatch):
    """A folder that is not mounted is written through Arrow's file systems, and mapped from a copy."""
    from pyarrow.fs import LocalFileSystem

    class Far:
        from_uri = staticmethod(lambda uri: (LocalFileSystem(), str(tmp_path / "far")))

    monkeypatch.setattr(succinct, "FileSystem", Far)
    monkeypatch.setattr(succinct.tempfile, "gettempdir", lambda: str(tmp_path / "node"))
    for _ in range(2):
        succinct.save("store://x/lm", "pairs/3", a=np.arange(5), b=np.zeros(0))
    assert succinct.load("store://x/lm", "pairs/3")["a"].tolist() == [0, 1, 2, 3, 4] and (tmp_path / "far/pairs/3").exists() and len(list((tmp_path / "far/pairs").iterdir())) == 1


def statistics(t):
    """The statistics of a text in plain Python."""
    import regex

    t = t or ""
    w, lines = t.encode().split(), [x for x in t.split("\n") if x.strip(" ")]
    w = [x.decode() for x in w]
    per = lambda x, n: x / n if n else 0.0
    left = lambda p: len(regex.sub(p, "", t))
    n, m, k = len(t), len(w), len(lines)
    return {
        "log_chars": math.log1p(n), "log_words": math.log1p(m), "mean_word": per(sum(map(len, w)), m), "distinct_words": per(len(set(w)), m), "digits": per(n - left("[0-9]+"), n),
        "capitals": per(n - left(r"\p{Lu}+"), n), "symbols": per(left(r"[\p{L}\p{N}\t\n\x0b\f\r .,;:'\"!?()-]+"), n), "stops": per(n - left("[.!?]+"), m), "commas": per(n - left("[,;:]+"), m), "lines": per(k, m),
        "repeated_lines": per(k - len(set(lines)), k), "longest_word": math.log1p(max(map(len, w), default=0)), "odd_words": per(sum(not regex.search(r"\p{L}", x) for x in w), m),
        "short_words": per(sum(len(x) <= 3 for x in w), m), "wide": per(len(t.encode()) - n, n), "runs": per(n - len(regex.sub(r"([^\t\n\x0b\f\r ])\1{2,}", r"\1", t)), n),
        "symbol_ends": per(sum(bool(regex.search(r"[^\p{L}\p{N}.,;:'\"!?()-]$", x)) for x in w), m), "top_line": math.log1p(max(map(len, lines), default=0)),
    }


def test_statistics_and_compiled_rules_over_texts(spark, sf):
    """The columns against plain Python, and op4's scores against the learnt rules applied to those numbers."""
    odd = [None, "", " ", "\n \n", "aaa  bbbb\t##éÉÉÉ x\x0by\x0cz\r\n1,2;3! 漢\U0001f600$ $", "word " * 30_000]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    learnt = rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(queries.remainder("doc_id", 3) != 1))
    assert learnt.rules
    held = rules.with_statistics(rules.classify(docs, learnt)).collect()
    x = np.array([[statistics(r.text)[s] for s in rules.STATS] for r in held])
    assert np.allclose(x, [[r[f"_s_{s}"] for s in rules.STATS] for r in held], atol=1e-12)
    own = 1 / (1 + np.exp(-(learnt.intercept + sum(w * rules._holds(x, c) for c, w in learnt.rules))))
    assert np.allclose(own, [r.score for r in held]) and [r.predicted for r in held] == [int(s >= 0.5) for s in own]


def test_few_labels_are_learnt_from():
    """Twelve rows that one statistic parts: there is no least number of rows, but five have to be on either side."""
    x = np.zeros((12, len(rules.STATS)))
    x[6:, 3] = 1.0
    y = (np.arange(12) >= 6).astype(float)
    learnt = rules.learn(x, y)
    assert learnt.rules and all(j == 3 for c, _ in learnt.rules for j, _, _ in c)
    assert not rules.learn(x[4:9], y[4:9]).rules


def test_pipeline_quality_stage_with_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (5, "", "en", "s", 1), (5, "", "en", "s", 1), (6, "x" * 300_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    learnt = rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(queries.remainder("doc_id", 3) != 1))
    got = corpus_pipeline.quality(spark, docs, sf)
    assert got.columns == corpus_pipeline.COLUMNS and got.count() == rules.classify(docs, learnt).where("predicted = 1").count()
    assert corpus_pipeline.quality(spark, docs.limit(0), sf).count() == 0


def test_opened_levels_hold_no_memory_of_their_own(spark, monkeypatch, sf):
    """Each shard that a task opens is the mapped file alone, and all shards share one table of values: memory does not grow with the shards."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20000)
    model = lm.train(spark.read.parquet(f"{sf}/documents.parquet"))
    levels = lm.Levels(model)
    shards = [levels._pairs(int(s)) for s in np.flatnonzero(model.held)]
    words = [levels._vocab(int(s)) for s in np.flatnonzero(np.diff(model.first))]
    assert len(shards) > 3 and len(words) > 3

    def mapped(a):
        while isinstance(a, np.ndarray):
            if isinstance(a, np.memmap):
                return True
            a = a.base
        return False

    found = [x for level in shards + words for part in level for x in (part.__dict__.values() if isinstance(part, EliasFano) else [part]) if isinstance(x, np.ndarray)]
    own = {id(x): x.nbytes for x in found if not mapped(x)}
    assert len(found) > 20 and len(own) == 2 and sum(own.values()) <= (256 + 65536) * 8


def test_few_shards_of_pairs(spark, monkeypatch, sf):
    """Pairs of several shards of words share a shard until it is full, so the shards follow the tokens and not the 64 shards of words; scores stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = lm.train(docs)
    assert len(model.cuts) == 1 + model.tokens // lm.SHARD_TOKENS
    whole = {r.doc_id: r.score for r in lm.score(docs, model).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", model.tokens // 5)
    model = lm.train(docs)
    assert 5 <= len(model.cuts) <= 16
    parts = {r.doc_id: r.score for r in lm.score(docs, model).collect()}
    assert whole.keys() == parts.keys() and all(abs(parts[k] - v) < 1e-3 * abs(v) for k, v in whole.items())
