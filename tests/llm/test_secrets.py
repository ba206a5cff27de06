import hashlib
import re

from pyspark.sql import functions as F

from sparrowlake.llm import queries, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def text_of(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_op10_over_documents(spark):
    sf = "/root/testdata/sf0.01"  # the smallest documents hold no secret
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False))
    got = queries.op10(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    some = 0
    for r in got:
        want = base(texts[r.doc_id])
        some += len(want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert set(filter(None, text_of(want).split(","))) <= set(r.spans.split(","))
    assert some > 5


ODD = [
    None, "", "token : x secret=token : abcdefghij", "PassWord='abcdefgh1' é😀 api_key: 12345678", "AKIAAKIAAKIAAKIA1 AKIAABCDEFGHIJK", "0" * 31 + "g" + "f" * 32, "apikey=token=abcdefgh " * 300,
    "ſecret=abcdefgh toKen=abcdefgh", "secret=" + "a1" * 40,
]


def test_edges(spark):
    rows = [(i % 3, t, f"o{i}", None) for i, t in enumerate(ODD)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, Spans string")
    got = secrets.judge(secrets.find(df), "owner", "owner").withColumn("joined", secrets.joined(F.filter("spans", lambda s: s["kind"] < 3))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.joined == text_of(base(r.text or "")), r.text
    assert secrets.judge(secrets.find(df.limit(0)), "owner", "owner").count() == 0


def test_ownership_and_redaction(spark):
    common, own, loose = "token=Example12345", "token=Q7own9secret", "sk_Live9f8Gh2Kq0Zx7Lm3Np1"
    rows = [(i, f"é {common}", f"o{i}") for i in range(4)] + [(9, f"{own} and {loose}.", "o9"), (10, f"{own}", "o9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string")
    got = {r.doc_id: r for r in secrets.redact(secrets.judge(secrets.find(df), "owner", "owner")).collect()}
    assert got[0].text == "é [EXAMPLE]" and got[9].text == "[SECRET] and [SECRET]." and got[10].text == "[SECRET]"
    assert [s.kind for s in got[9].spans] == [0, 3] and got[9].spans[0].owners == 1


def test_running_values(spark):
    import itertools

    ops = {"sum": (secrets._sum, lambda a, b: a + b), "most": (secrets._most, max), "least": (secrets._least, min)}
    import random

    random.seed(3)
    rows = [(n, [random.randint(0, 50) for _ in range(n)]) for n in (0, 1, 2, 63, 64, 65, 4095, 4096, 4097, 5000)]
    df = spark.createDataFrame(rows, "n int, x array<int>")
    for f, want in ops.values():
        for r in df.withColumn("y", secrets.running(F.col("x"), f)).collect():
            assert r.y == list(itertools.accumulate(r.x, want)), r.n


def test_loose_spans_that_base_spans_overlap(spark):
    key = "sk_Live9f8Gh2Kq0Zx7Lm3Np1"
    texts = {"token=" + key: 0, key: 1, f"{key} token={key} {key}": 2, "A" + "f" * 40 + "1 " + key: 1, f"{key},token=abcdefgh1,{key}": 2}
    df = spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)], "doc_id long, text string, owner string")
    for r in secrets.find(df).collect():
        assert sum(s.kind == 3 for s in r.found) == texts[r.text], r.text


def test_many_matches_take_linear_time(spark):
    """100,000 matches in one text, found, judged and redacted, in time in proportion to them."""
    import time

    took = {}
    for n in (1000, 25_000, 100_000):
        words = [hashlib.md5(str(i).encode()).hexdigest() for i in range(n)]
        df = spark.createDataFrame([(1, " é ".join(words), "o"), (2, "nothing", "p")], "doc_id long, text string, owner string").coalesce(1)
        t = time.time()
        got = {r.doc_id: r for r in secrets.redact(secrets.judge(secrets.find(df), "owner", "owner")).collect()}
        took[n] = time.time() - t
        assert got[1].text == " é ".join(["[SECRET]"] * n) and [(s.start, s.end) for s in got[1].spans] == [(35 * i, 35 * i + 32) for i in range(n)]
        assert got[2].text == "nothing" and not got[2].spans
    assert took[100_000] < 8 * took[25_000], took


def test_ownership_against_brute_force(spark):
    """Owners and repositories of each base span over whole documents, counted in dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("repository", F.concat_ws("/", "source", "lang"))
    got = secrets.judge(secrets.find(docs), "source", "repository").collect()
    held, values = {}, {}
    for r in got:
        t = r.text or ""
        for s in r.spans:
            m = ASSIGN.fullmatch(t[s.start : s.end]) if s.kind == 0 else None
            v = values[r.doc_id, s.kind, s.start] = m[2] if m else t[s.start : s.end]
            assert s.kind < 3 or s.live
        for a, k, b in base(t):  # what counts is every candidate's value, whatever its kind
            held.setdefault(values[r.doc_id, k, a], set()).add((r.source, r.repository))
    loose = {v for (_, k, _), v in values.items() if k == 3}
    checked = 0
    for r in got:
        for s in r.spans:
            v = values[r.doc_id, s.kind, s.start]
            if s.kind < 3 and v not in loose:
                checked += 1
                assert (s.owners, s.repositories, s.live) == (len({o for o, _ in held[v]}), len(held[v]), len({o for o, _ in held[v]}) < 3)
    assert checked > 5
