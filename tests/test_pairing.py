"""Item pairs: many blocks and waves against plain Python, and no shuffle of a row a pair."""

import re

import numpy as np
import pytest

from sparrowlake.operators import itemcf, pairing


@pytest.fixture()
def small(monkeypatch):
    """Blocks, chunks and waves of a few pairs."""
    for name, n in (("BLOCK_PAIRS", 300), ("CHUNK", 50), ("MOST_PAIRS", 120), ("LEAST_WAVE", 3000), ("WAVE_BYTES", 1)):
        monkeypatch.setattr(pairing, name, n)


@pytest.fixture(scope="module")
def rated(spark):
    """One user with every item, a common item, and ratings with fractions, negative and large ids."""
    rng = np.random.default_rng(7)
    rows = {(u, int(i)) for u in range(40) for i in rng.choice(60, 9)} | {(u, 5) for u in range(40)} | {(41, i) for i in range(60)} | {(42, 999)}
    rows = [(u, i * 7 - 100 + 10**9 * (i == 8), float(rng.integers(1, 16)) / 3) for u, i in sorted(rows)]
    return rows, itemcf.pairs(spark.createDataFrame(rows, "user_id long, item_id long, rating double"), "user_id", "item_id", "rating").persist()


def together(rows):
    """(i, j): ratings of both by their common users, in both directions."""
    users, out = {}, {}
    for u, i, r in rows:
        users.setdefault(u, []).append((i, r))
    for own in users.values():
        for i, r in own:
            for j, q in own:
                if i != j:
                    out.setdefault((i, j), []).append((r, q))
    return out


def no_row_a_pair(df):
    assert not re.search(r"hashpartitioning\(item_i#\w+, item_j", df._jdf.queryExecution().toString())


def test_regression(rated, small):
    rows, x = rated
    want = {}
    for (i, j), v in together(rows).items():
        a, b = np.array(v).T
        if i < j and len(v) >= 3 and a.min() < a.max():
            slope = ((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum()
            want[i, j] = (len(v), slope, b.mean() - slope * a.mean())
    s = itemcf.regression(x, 3)
    no_row_a_pair(s)
    got = {(r.item_i, r.item_j): (r.n, r.slope, r.intercept) for r in s.collect()}
    assert len(want) > 100 and got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_regression_other_items(spark):
    """Items that are texts, and ratings that are missing, take the join."""
    rows = [(u, i, float((u * 7 + i) % 5)) for u in range(9) for i in range(4)]
    of = lambda kind, r: itemcf.regression(itemcf.pairs(spark.createDataFrame(r, f"user_id long, item_id {kind}, rating double"), "user_id", "item_id", "rating"))
    want = {(str(r.item_i), str(r.item_j)): r[2:] for r in of("long", rows).collect()}
    assert want and {(r.item_i, r.item_j): r[2:] for r in of("string", [(u, str(i), r) for u, i, r in rows]).collect()} == want
    assert of("long", [*rows, (77, 1, None), (77, 2, 1.0)]).count() == len(want)
    assert of("long", rows[:1]).count() == 0


def test_regression_predictions(rated, small):
    rows, x = rated
    lines = itemcf.regression(x, 3)
    s = itemcf.regression_predict(x, lines)
    no_row_a_pair(lines)
    of, own, want = {(r.item_i, r.item_j): (r.slope, r.intercept) for r in lines.collect()}, {}, {}
    for u, i, r in rows:
        own.setdefault(u, {})[i] = r
    for u, mine in own.items():
        for (i, j), (slope, start) in of.items():
            if i in mine and j not in mine:
                want.setdefault((u, j), []).append(start + slope * mine[i])
    got = {(r.u, r.item_id): (r.predicted, r.support) for r in s.collect()}
    assert len(want) > 100 and got.keys() == want.keys() and all(np.allclose(got[k], (np.mean(v), len(v)), atol=2e-6) for k, v in want.items())


def best(sim, k):
    out = {}
    for i in {i for i, _ in sim}:
        mine = sorted((-round(v, 9), j) for (a, j), v in sim.items() if a == i)[:k]
        out |= {(i, j): (n + 1, sim[i, j]) for n, (_, j) in enumerate(mine)}
    return out


def same(df, sim, k=3):
    no_row_a_pair(df)
    got, want = {(r.item_i, r.item_j): (r["rank"], r.sim) for r in df.collect()}, best(sim, k)
    assert len(want) > 100 and got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-9 for p in want)


def mean(rows, at):
    held = {}
    for r in rows:
        held.setdefault(r[at], []).append(r[2])
    return {k: sum(v) / len(v) for k, v in held.items()}


def test_pearson(rated, small):
    rows, x = rated
    m, sim = mean(rows, 1), {}
    for (i, j), v in together(rows).items():
        a, b = np.array(v).T - [[m[i]], [m[j]]]
        if len(v) >= 2 and (a * a).sum() > 1e-12 and (b * b).sum() > 1e-12:
            sim[i, j] = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())
    same(itemcf.pearson(x, 3), sim)


def test_adjusted_cosine(rated, small):
    rows, x = rated
    m = mean(rows, 0)
    less = [(u, i, r - m[u]) for u, i, r in rows]
    size = {}
    for _, i, r in less:
        size[i] = size.get(i, 0) + r * r
    same(itemcf.adjusted_cosine(x, 3), {(i, j): sum(a * b for a, b in v) / (size[i] * size[j]) ** 0.5 for (i, j), v in together(less).items() if min(size[i], size[j]) > 1e-12})


def cosines(rows):
    d = {}
    for _, i, _ in rows:
        d[i] = d.get(i, 0) + 1
    return {(i, j): len(v) / (d[i] * d[j]) ** 0.5 for (i, j), v in together(rows).items()}


def test_cosine(rated, small):
    rows, x = rated
    same(itemcf.cosine(x, 3), cosines(rows))


def test_iuf(rated, small):
    rows, x = rated
    n, d = {}, {}
    for u, i, _ in rows:
        n[u], d[i] = n.get(u, 0) + 1, d.get(i, 0) + 1
    weighted = [(u, i, 1 / np.log1p(n[u])) for u, i, _ in rows]
    same(itemcf.iuf(x, 3), {(i, j): sum(a * b for a, b in v) / (d[i] * d[j]) ** 0.5 for (i, j), v in together(weighted).items()})


def test_row_normalized(rated, small):
    rows, x = rated
    sim, s = best(cosines(rows), 3), itemcf.row_normalized(itemcf.cosine(x, 3))
    no_row_a_pair(s)
    got = {(r.item_i, r.item_j): r.sim for r in s.collect()}
    top = {i: v for (i, _), (rank, v) in sim.items() if rank == 1}
    assert got.keys() == sim.keys() and all(abs(got[p] - sim[p][1] / top[p[0]]) < 1e-9 for p in sim)


def test_row_normalized_in_blocks(rated, small):
    """Scaled where the pairs are added up: the same figures, and nothing is shuffled after the blocks."""
    rows, x = rated
    sim, s = best(cosines(rows), 3), itemcf.cosine(x, 3, normed=True)
    assert "Exchange" not in s._jdf.queryExecution().toString()
    got = {(r.item_i, r.item_j): r.sim for r in s.collect()}
    top = {i: v for (i, _), (rank, v) in sim.items() if rank == 1}
    assert got.keys() == sim.keys() and all(abs(got[p] - sim[p][1] / top[p[0]]) < 1e-9 for p in sim)
    assert itemcf.cosine(x.where("u < 0"), 3, normed=True).count() == 0


def test_row_normalized_of_texts(spark):
    rows = [(u, str(i)) for u in range(9) for i in range(5) if (u * 3 + i * i) % 4]
    x = itemcf.pairs(spark.createDataFrame(rows, "user_id long, item_id string"), "user_id", "item_id")
    got = {(r.item_i, r.item_j): r.sim for r in itemcf.cosine(x, 3, normed=True).collect()}
    assert got and got == {(r.item_i, r.item_j): r.sim for r in itemcf.row_normalized(itemcf.cosine(x, 3)).collect()}


def test_waves_let_their_files_go(spark, rated, small, monkeypatch):
    """Each wave finds no shuffle file of one before it, and only the result stays of the tables written."""
    import time
    from pathlib import Path

    _, x = rated
    tables = lambda: {p.name for p in Path(pairing._shared(spark).removeprefix("file://"), "sparrowlake").glob("*")}
    before, live, let_go = tables(), [], pairing.let_go
    shuffles = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    def counted(s):
        let_go(s)
        time.sleep(0.3)  # the cleaner works in the background
        live.append(shuffles())

    monkeypatch.setattr(pairing, "let_go", counted)
    s = itemcf.cosine(x, 3)
    assert len(live) > 4 and live[-1] <= live[2]
    assert len(tables() - before) == 1 and s.count() > 100


def test_top_unseen_in_waves(rated, small):
    """More than one wave of users, and the same rows as in one."""
    rows, x = rated
    near = best(cosines(rows), 4)
    own, want = {}, {}
    for u, i, r in rows:
        own.setdefault(u, {})[i] = r
    for u, mine in own.items():
        for (i, j), (_, s) in near.items():
            if i in mine and j not in mine:
                num, size = want.get((u, j), (0, 0))
                want[u, j] = (num + s * mine[i], size + s)
    df = itemcf.top_unseen(x, itemcf.cosine(x, 4), 1000, weighted=True)
    assert "Exchange" not in df._jdf.queryExecution().toString()  # the waves are written
    got = {(r.u, r.item_id): (r.score, r.sim_sum) for r in df.collect()}
    assert len(want) > 100 and got.keys() == want.keys() and all(np.allclose(got[k], (want[k][0] / want[k][1], want[k][1]), atol=2e-6) for k in want)


def test_experiment_in_waves(spark, small, monkeypatch):
    """An experiment whose pairs and recommendations come in waves has the figures of one in one wave, and no exchange by pairs of items."""
    from datetime import datetime, timedelta

    from sparrowlake.plans import runs

    rows = [(u, (u * 5 + n * n) % 30, datetime(2024, 1, 1) + timedelta(days=n), u * 100 + n) for u in range(30) for n in range(12)]
    log = spark.createDataFrame(rows, "user_id long, item_id long, ts timestamp, row_id long").persist()
    monkeypatch.setattr(pairing, "LEAST_WAVE", 20_000)
    s = runs.experiment(log, "ts", "row_id")
    no_row_a_pair(s)
    got = sorted(map(str, s.collect()))
    monkeypatch.setattr(pairing, "LEAST_WAVE", 1 << 30)
    assert len(got) == 10 and got == sorted(map(str, runs.experiment(log, "ts", "row_id").collect()))


def test_top_unseen_by_blocks(spark, small, monkeypatch):
    """Many blocks of users against plain Python: negative similarities and ids, an item of many users, and items without similar ones; texts give the same by a join."""
    from sparrowlake.operators import unseen

    monkeypatch.setattr(unseen, "MANY_USERS", 10)
    rng = np.random.default_rng(3)
    own = {u: {int(i) * 3 - 40 for i in rng.choice(50, 7)} | {500} for u in range(-20, 60)}
    near = {(i * 3 - 40, int(j) * 3 - 40): float(rng.integers(-3, 9)) / 8 for i in range(45) for j in rng.choice(60, 6) if i != j} | {(500, 503): 0.25}
    for plain in (False, True):
        sims, want = {p: abs(s) + 0.125 if plain else s for p, s in near.items()}, {}
        for u, mine in own.items():
            got = {}
            for (i, j), s in sims.items():
                if i in mine and j not in mine:
                    num, size = got.get(j, (0, 0))
                    got[j] = (num + s, size + abs(s))
            fresh = sorted((-round(n / z, 6), -round(z, 6), j) for j, (n, z) in got.items() if z > 0)[:5]
            want |= {(u, r + 1): (j, -a, -b) for r, (a, b, j) in enumerate(fresh)}
        x = lambda kind: spark.createDataFrame([(kind(u), i, 1.0) for u, mine in own.items() for i in mine], f"u {'string' if kind is str else 'long'}, i long, r double")  # noqa: B023, E731
        df = spark.createDataFrame([(i, j, s) for (i, j), s in sims.items()], "item_i long, item_j long, sim double")
        found = itemcf.top_unseen(x(int), df, 5)
        assert unseen.top(x(int), df, 5) is not None and unseen.top(x(str), df, 5) is None
        for got in (found, itemcf.top_unseen(x(str), df, 5)):
            assert {(int(r.u), r["rank"]): (r.item_id, r.score, r.sim_sum) for r in got.collect()} == want


def test_experiment_keeps_no_tables(spark):
    """Only the split and the recommendations that the result reads stay on disk."""
    from datetime import datetime, timedelta
    from pathlib import Path

    from sparrowlake.plans import runs

    rows = [(u, (u * 5 + n * n) % 30, datetime(2024, 1, 1) + timedelta(days=n), u * 100 + n) for u in range(9) for n in range(12)]
    folder = Path(pairing._shared(spark).removeprefix("file://"), "sparrowlake")
    before = set(folder.glob("*"))
    s = runs.experiment(spark.createDataFrame(rows, "user_id long, item_id long, ts timestamp, row_id long"), "ts", "row_id")
    assert sorted(p.name.split("-")[0] for p in set(folder.glob("*")) - before) == ["split", "unseen"]
    assert s.count() == 10


def counts(df):
    return {(r.item_i, r.item_j): r.together for r in df.collect()}


@pytest.mark.parametrize("bytes_each", [0, 1 << 20])
def test_cooccurrence(rated, small, monkeypatch, bytes_each):
    """In waves and in one pass; the counts of two batches, of other users or the same, are added up with no row a pair either."""
    monkeypatch.setattr(pairing, "ONCE_BYTES", bytes_each)
    rows, x = rated
    want = {k: len(v) for k, v in together(rows).items() if k[0] < k[1]}
    whole = itemcf.cooccurrence(x)
    no_row_a_pair(whole)
    assert counts(whole) == want and len(want) > 500
    parts = itemcf.merge_cooccurrence(itemcf.cooccurrence(x.where("u % 2 = 0")), itemcf.cooccurrence(x.where("u % 2 = 1")))
    no_row_a_pair(parts)
    assert counts(parts) == want
    assert counts(itemcf.merge_cooccurrence(whole, parts)) == {k: 2 * n for k, n in want.items()}
    assert counts(itemcf.cooccurrence(x.where("u < 0"))) == {} and counts(itemcf.merge_cooccurrence(itemcf.cooccurrence(x.where("u < 0")), whole)) == want


def test_cooccurrence_of_other_items(spark, rated):
    """Items that are texts or lie far apart, and counts that come from elsewhere."""
    rows, x = rated
    want = {k: len(v) for k, v in together(rows).items() if k[0] < k[1]}
    text = itemcf.cooccurrence(x.selectExpr("u", "concat('a', lpad(i + 200, 12, '0')) AS i", "r"))
    assert sorted(r.together for r in text.collect()) == sorted(want.values())
    far = lambda i: i + (1 << 40) * (i == 999)
    assert counts(itemcf.cooccurrence(x.unionAll(spark.createDataFrame([(0, far(999), 1.0)], x.schema)))).items() >= want.items()
    stored = spark.createDataFrame([(i, j, n) for (i, j), n in want.items()], "item_i long, item_j long, together long")
    assert counts(itemcf.merge_cooccurrence(stored, itemcf.cooccurrence(x))) == {k: 2 * n for k, n in want.items()}
