import random

import numpy as np
import pytest

from sparrowlake.llm import near_dup
from tests_llm_helpers import shingles


def brute(rows, k, num=80, den=100):
    """(doc_id, n, component) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for a, (i, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(a)
    seen = set()
    for a, (i, s) in enumerate(sets):
        for b in {b for x in s for b in where[x] if b < a}:
            t = sets[b][1]
            common = len(s & t)
            if den * common >= num * (len(s) + len(t) - common):
                p, q = sorted((find(i), find(sets[b][0])))
                parent[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


def run(df, **kw):
    got = near_dup.classes(df, **kw).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("k", [4, 5])
def test_classes_over_documents(spark, sf, k):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], k)
    assert len({c for _, _, c in want}) < len(want)
    assert run(d, k=k) == want


def test_groups_and_chains(spark):
    """A large group of near copies, a chain whose ends are unlike, boilerplate that many share, and edge cases."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = [(1000 + i, " ".join(base[:j] + [word()] + base[j + 1 :])) for i, j in enumerate(rnd.sample(range(120), 60))]
    chain = [word() for _ in range(100)]
    for i in range(25):
        rows.append((2000 - i, " ".join(chain)))
        at = (i * 4) % 100
        chain[at : at + 4] = [word() for _ in range(4)]
    shared = " ".join(word() for _ in range(60))
    rows += [(3000 + i, shared + " " + " ".join(word() for _ in range(40))) for i in range(50)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two x"), (7, "É a b c d"), (8, "é a b c d")]
    rows += [(9, "same row twice here now"), (9, "same row twice here now"), (10, "same row twice here now")]
    rows += [(11, " ".join(base)), (11, "quite another text that links nothing"), (12, "quite another text that links nothing")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows] + [(None, "one two", "x", 1)], "doc_id long, text string, bands string, n long")
    assert run(df, k=4) == brute(rows, 4)
    assert near_dup.classes(df.where("doc_id IS NULL")).collect()[0].component_id is None
    assert near_dup.classes(df.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    new = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    pairs = []
    for _ in range(60):
        base = new(400)
        pairs.append((np.unique(base), np.unique(np.concatenate([base[:300], new(100)]))))
    a, b = (near_dup.sketch([p[i] for p in pairs], 288) for i in (0, 1))
    assert not (a == near_dup.EMPTY).any()
    assert abs((a == b).mean() - 300 / 500) < 0.02
    one = near_dup.sketch([np.array([7], np.uint64)] * 2, 288)
    assert (one[0] == one[1]).all() and not (one == near_dup.EMPTY).any()


def test_repeated_rows_meet_across_classes(spark):
    """One bucket of a hub and two near copies of each other that are unlike the hub and occur three times each."""
    memo = near_dup.Memo()
    sketched = lambda t: near_dup.sketch(near_dup.shingle_sets(near_dup.pa.array([t]), 4, memo), 1)[0, 0]
    for seed in range(50):
        rnd = random.Random(seed)
        word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
        base = [word() for _ in range(100)]
        changed = lambda places: " ".join(word() if i in places else w for i, w in enumerate(base))
        hub, a, b = changed({5, 17, 35, 53, 71, 89}), " ".join(base), changed({26, 62})
        if sketched(hub) == sketched(a) == sketched(b):
            break
    else:
        raise AssertionError("no seed puts the three in one bucket")
    rows = [(1, hub), *[(2, a)] * 3, *[(3, b)] * 3]
    want = brute(rows, 4)
    assert {(i, c) for i, _, c in want} == {(1, 1), (2, 2), (3, 2)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, k=4, bands=1, rows=1) == want


def set_of(numbers):
    return [int(x) for x in sorted({random.Random(n).getrandbits(63) for n in numbers})]


def sets_frame(spark, sets):
    return spark.createDataFrame([(i, i, s) for i, s in sets], "doc_id long, component long, shingles array<long>")


def test_crossing_is_exact(spark):
    """Every pair at 0.8 or more of random sets of many sizes that share a passage, against all pairs."""
    rnd, sets = random.Random(5), []
    for i in range(260):
        shared, own = rnd.randint(0, 90), rnd.randint(0, 30)
        sets.append((i, set_of([*range(shared), *(rnd.randint(1000, 1400) if rnd.random() < 0.5 else 10_000 * i + 5000 + j for j in range(own + (shared == 0)))])))
    want = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))}
    got = {(r.a, r.b) for r in near_dup.crossing(sets_frame(spark, sets), 80, 100).collect()}
    assert len(want) > 50 and want <= got and len(got) < 2 * len(want)


def test_boilerplate_makes_no_pairs(spark):
    """20,000 sets that share a passage at 0.75 of their union: a shingle that all of them hold makes no pairs, and the time is in proportion."""
    import time

    from pyspark.sql import functions as F

    took = {}
    for n in (5_000, 20_000):
        shared = F.sequence(F.lit(1).cast("long"), F.lit(60).cast("long"))
        own = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.xxhash64("id", j))
        df = spark.range(1000, 1000 + n).select(F.col("id").alias("doc_id"), F.col("id").alias("component"), F.array_sort(F.concat(F.transform(shared, lambda x: F.xxhash64(x)), own)).alias("shingles"))
        t = time.time()
        assert near_dup.crossing(df, 80, 100).count() == 0
        took[n] = time.time() - t
    assert took[20_000] < 6 * took[5_000], took


def test_a_stranger_as_the_smallest_member(spark):
    """300 near copies of one text whose buckets all have an unlike document as their smallest member."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = [(1, " ".join(base[:128]) + " " + " ".join(word() for _ in range(40)))]
    rows += [(100 + i, " ".join(base[:j] + [word()] + base[j + 1 :])) for i, j in enumerate(rnd.choices(range(130, 150), k=300))]
    want = brute(rows, 4)
    assert {(i == 1, c) for i, _, c in want} == {(True, 1), (False, 100)}
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), k=4) == want


def test_a_very_long_text(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:])), (3, " ".join(words[:120_000])), (4, "a b c d e")]
    assert [(i, c) for i, _, c in run(spark.createDataFrame(rows, "doc_id long, text string"), k=5)] == [(1, 1), (2, 1), (3, 3), (4, 4)]
