import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowlake.llm import ann, contamination, licenses, queries
from tests_llm_helpers import shingles


def test_op1_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, shingles(r.text, 5)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = []
    for d in docs:
        s = shingles(d.text, 5)
        want += [(d.doc_id, i, len(s & t), len(t)) for i, t in items if t and 100 * len(s & t) >= 80 * len(t)]
    assert want and sorted(tuple(r) for r in queries.op1(spark, sf).collect()) == sorted(want)


def test_containment_in_long_documents(spark, monkeypatch):
    """Items of many sizes, whole, scattered and with changed words, in documents of up to 40,000 words; in several blocks."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    items = [(i, word(n)) for i, n in enumerate((5, 9, 20, 40, 80, 200, 700, 3))]
    docs = []
    for size in (0, 200, 5000, 40_000):
        for i, w in items:
            changed = [x if rng.random() > 0.02 else "zz" for x in w]
            docs.append((len(docs), " ".join(word(size // 2) + w + word(size // 2))))
            docs.append((len(docs), " ".join(word(size // 3) + changed[: len(w) // 2] + word(size // 3) + changed[len(w) // 2 :] + word(size // 3))))
    docs += [(900, None), (901, ""), (902, " ".join(items[2][1]).upper()), (902, " ".join(items[2][1]).upper())]
    bench = [(i, " ".join(w)) for i, w in items] + [(2, " ".join(items[2][1])), (50, None), (51, " "), (None, "a b c d e f")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, Leaks string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    sets = {i: shingles(t, 5) for i, t in bench if t and t.strip() and i is not None}
    want = sorted((i, j) for i, t in docs for j, s in sets.items() if 100 * len(shingles(t, 5) & s) >= 80 * len(s))
    got = contamination.annotate(d, b)
    assert got.columns == ["doc_id", "text", "leaks"] and len(want) > 40
    assert sorted((r.doc_id, r.item_id) for r in got.select("doc_id", F.inline("leaks")).collect()) == want
    monkeypatch.setattr(contamination, "BLOCK_SHINGLES", 300)
    assert sorted((r.doc_id, r.item_id) for r in contamination.annotate(d, b).select("doc_id", F.inline("leaks")).collect()) == want
    assert contamination.annotate(d, b.limit(0)).where("size(leaks) > 0").count() == 0
    assert contamination.annotate(d.limit(0), b).count() == 0


def test_short_items_inside_long_documents(spark, tmp_path):
    """op1 and the pipeline's stage find items of 1 to 4 words inside longer documents, and longer items as before."""
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    items = [(n, word(n)) for n in range(1, 8)] + [(10, word(3))]
    docs = [(100 * size + i, " ".join(word(size) + w + word(size))) for size in (0, 1, 3, 500) for i, w in items]
    docs += [(90_000, " ".join(word(9) + items[3][1][::-1] + word(9))), (90_001, " ".join(items[3][1][:3])), (90_002, None), (90_003, "")]
    bench = [(i, " ".join(w).upper()) for i, w in items] + [(11, " ".join(items[7][1])), (12, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    for i, t in docs:
        for j, u in bench:
            k = min(5, len((u or "").split()))
            held, s = shingles(t, k), shingles(u, 5)
            if s and 100 * len(held & s) >= 80 * len(s):
                want.add((i, j, len(held & s), len(s)))
    assert all((100 * size + i, i) in {w[:2] for w in want} for size in (0, 1, 3, 500) for i, _ in items)
    got = [tuple(r) for r in queries.op1(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    kept = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {i for i, _ in docs} - {w[0] for w in want}


def _exact(x, ids, q, k):
    u = x / np.sqrt((x**2).sum(1))[:, None]
    out = []
    for i in np.flatnonzero(q):
        s = (u * u[i]).sum(1)
        s[ids == ids[i]] = -9
        best = np.lexsort((ids, -s))[:k]
        out.append([(int(ids[b]), float(s[b])) for b in best if s[b] > -9])
    return out


def test_op7_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = queries.op7(spark, "/root/testdata/sf0.01").toPandas()
    hit = total = 0
    for i, want in zip(ids[ids % 50 == 0], _exact(x, ids, ids % 50 == 0, 5)):
        g = got[got.query_id == i].sort_values("rank")
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and g.vec_id.is_unique and i not in set(g.vec_id)
        assert list(g.score) == sorted(g.score, reverse=True)
        hit += len(set(g.vec_id) & {w for w, _ in want})
        total += len(want)
        scores = dict(want)
        assert all(abs(scores[v] - s) < 1e-12 for v, s in zip(g.vec_id, g.score) if v in scores)
    assert hit >= 0.9 * total


def _recall(spark, sf, modulus):
    """Share of the exact neighbours that op7's search finds."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    asked = ids % modulus == 0
    found = {q: set(g.vec_id) for q, g in ann.search(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % modulus == 0).toPandas().groupby("query_id")}
    want = {int(i): {w for w, _ in near} for i, near in zip(ids[asked], _exact(x, ids, asked, 5))}
    return sum(len(found[i] & w) for i, w in want.items()) / sum(map(len, want.values()))


def test_op7_recall_of_a_larger_table(spark):
    assert _recall(spark, "/root/testdata/sf0.1", 50) >= 0.9


def test_clustered_vectors_take_few_leaves(spark, tmp_path):
    """20,000 vectors around 400 centres: recall holds with a small share of the leaves."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(400, 32))
    x = centres[rng.integers(0, 400, 20_000)] + 0.15 * rng.normal(size=(20_000, 32))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    tree, _ = ann.fit(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    assert tree.leaves > 200 and tree.visits < 0.1 * tree.leaves
    assert _recall(spark, str(tmp_path), 50) >= 0.9


def test_leaves_grow_with_the_table(spark):
    """The sample follows the square root of the rows between its bounds."""
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 4)))], "vec_id long, embedding array<double>")
    leaves = [ann.fit(df.where(f"vec_id < {n}"), sample_rows=(100, 100_000))[0].leaves for n in (250, 1000, 4000)]
    assert leaves[0] < leaves[1] < leaves[2]


def test_first_of_equal_vectors():
    """Equal vectors of many ids, and of one id many times: no query loses a neighbour."""
    ids = np.array([5] * 9 + [7, 3, 8, 9, 11, 12, 13])
    x = np.ones((len(ids), 2))
    for k in (1, 3, 5):
        kept, _ = ann._first_of_equal(ids, x, k)
        for q in (3, 5, 7, 99):
            want = sorted(i for i in ids if i != q)[:k]
            assert sorted(i for i in kept if i != q)[:k] == want


def test_ann_ties_hot_leaf_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 64)
    monkeypatch.setattr(ann, "BLOCK", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(300)] + [(1000 + i, rng.normal(size=3).tolist(), 1) for i in range(200)]
    rows += [(2000, None, 1), (2050, [0.0, 0.0, 0.0], 1), (2100, [1.0, None, 2.0], 1), (2150, [float("nan"), 1.0, 1.0], 1), (2200, [float("inf"), 1.0, 1.0], 1), (2250, [1.0], 1), (2300, [], 1), (None, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int")
    got = ann.search(df, F.col("vec_id") % 50 == 0).toPandas()
    assert set(got.query_id) == {*range(0, 300, 50), *range(1000, 1200, 50)}
    for q in range(0, 300, 50):
        assert list(got[got.query_id == q].sort_values("rank").vec_id) == [i for i in range(6) if i != q][:5]
    few = ann.search(df.where("vec_id IN (0, 1, 1000)"), F.col("vec_id") % 50 == 0).toPandas()
    assert sorted(few.groupby("query_id").size().tolist()) == [2, 2]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_ann_repeated_query_rows(spark):
    """A query row that occurs three times has the neighbours of one; an id with two vectors has five for each."""
    x = np.random.default_rng(9).normal(size=(200, 8))
    one = [(i, v.tolist()) for i, v in enumerate(x, 1)]
    query = [(0, x[150].tolist()), (1000, x[40].tolist())]
    search = lambda rows: sorted(map(tuple, ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 1000)).collect()))
    ids = np.array([i for i, _ in one + query])
    every = np.array([v for _, v in one + query])
    want = {int(q): [v for v, _ in w] for q, w in zip((0, 1000), _exact(every, ids, np.isin(ids, (0, 1000)), 5))}
    got = search(one + query + query[:1] * 2)
    assert {q: [v for i, _, v, _ in got if i == q] for q in want} == want
    other = [(0, x[40].tolist())]
    got = search(one + query[:1] * 2 + other * 2)
    assert [r for _, r, _, _ in got] == [r for r in range(1, 6) for _ in range(2)]
    assert {v for _, r, v, _ in got if r == 1} == {41, 151}


def _licenses(text):
    """Brute force: every window of every group against every template."""
    w, out = licenses.plain_words(text or ""), {}
    grams = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    if len(w) < 5:
        return out
    for up, _, names in licenses.plan():
        for i in range(0, max(-(-len(w) // up) - 2, 0) + 1):
            g = grams(w[i * up : i * up + 2 * up])
            for n in names:
                t = grams(licenses.plain_words(licenses.TEMPLATES[n]))
                if 100 * len(g & t) >= 80 * len(t):
                    k = out.setdefault(n, [0, 0.0, i * up + 1])
                    k[0], k[1] = k[0] + 1, max(k[1], len(g & t) / len(t))
    return out


def _notices(text):
    """Brute force: the word sequences of short notices in windows of 8 words."""
    w = licenses.plain_words(text or "")
    rest = " ".join(w).replace("released under the mit license", "- - - - -").split()
    for name, q in (("All-rights-reserved", ["all", "rights", "reserved"]), ("MIT-notice", ["mit", "license"]), ("Apache-2.0-notice", ["apache", "license", "2", "0"])):
        held = [i for i in range(max(-(-len(rest) // 4) - 2, 0) + 1) if any(rest[j : j + len(q)] == q for j in range(4 * i, min(4 * i + 8, len(rest)) - len(q) + 1))]
        if held:
            yield name, len(held), 1.0, 4 * held[0] + 1


def test_op5_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        want += [(r.doc_id, n, *v) for n, v in _licenses(r.text).items()] + [(r.doc_id, *x) for x in _notices(r.text)]
    assert len(want) > 10
    assert sorted((r.doc_id, r.license, r.windows, r.containment, r.start_word) for r in queries.op5(spark, sf).collect()) == sorted(want)


def test_license_edges(spark):
    rng = np.random.default_rng(1)
    fill = lambda n: " ".join(f"x{i}" for i in rng.integers(0, 9999, n))
    texts = [None, "", "license", "license " * 5000]
    for t in licenses.TEMPLATES.values():
        for n in (0, 3, 50, 400):
            texts.append(f"{fill(n)}\n{t.upper()}\n{fill(n)}")
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(7, texts[7], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    want = sorted((i, n, *v) for i, t, _ in rows for n, v in _licenses(t).items())
    assert {n for _, n, *_ in want} == set(licenses.TEMPLATES)
    assert sorted((r.doc_id, r.license, r.windows, r.containment, r.start_word) for r in licenses.scan(df).collect()) == want
    assert licenses.scan(df.limit(0)).count() == 0
    for t in licenses.TEMPLATES.values():  # a template is found wherever it begins
        assert all(_licenses(f"{fill(n)} {t} {fill(60)}") for n in range(0, 40))


def test_license_parameters(spark):
    """Own templates, one of 150 words, and no notices."""
    own = {"long": " ".join(f"clause{i} of contract" for i in range(50)), "short": "you may do with this contract as you like"}
    fill = " ".join(f"y{i}" for i in range(300))
    df = spark.createDataFrame([(1, f"{fill} {own['long'].upper()}. {fill}"), (2, f"{fill} {own['short']}"), (3, f"All rights reserved. Released under the MIT License. {fill}")], "doc_id long, text string")
    got = licenses.scan(df, texts=own, short={}, anchors=("contract",)).collect()
    assert sorted((r.doc_id, r.license, r.containment) for r in got) == [(1, "long", 1.0), (2, "short", 1.0)]
    with pytest.raises(ValueError):
        licenses.plan({"x": "no such word in these ten words at all here"}, ("contract",))


def test_op5_finds_short_notices(spark):
    """Every row of a short notice against a search of its word sequence in the windows of 8 words; and every document that carries the line has its row."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rng = np.random.default_rng(8)
    fill = lambda n: " ".join(f"x{i}" for i in rng.integers(0, 9999, n))
    texts = [f"{fill(n)} {t} {fill(m)}" for t in ("(c) Ann. ALL RIGHTS -- reserved!", "MIT License", "Apache License 2.0") for n in range(10) for m in (0, 1, 5, 30)]
    texts += ["All rights reserved.", "overall rights reserved", "all rights reservedly", "all rights x reserved", "Released under the MIT License.", None, "", fill(20)]
    texts += ["all rights reserved " * 7]
    rows = [(r.doc_id, r.text) for r in docs] + [(100_000 + i, t) for i, t in enumerate(texts)] + [(100_000, texts[0])]

    want = sorted((i, *x) for i, t in rows for x in _notices(t))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("license").isin(*licenses.NOTICES)).collect()
    assert sorted((r.doc_id, r.license, r.windows, r.containment, r.start_word) for r in got) == want
    lines = {r.doc_id for r in docs if "All rights reserved." in (r.text or "")}
    assert lines and lines == {r.doc_id for r in queries.op5(spark, "/root/testdata/sf0.01").collect() if r.license == "All-rights-reserved"}
