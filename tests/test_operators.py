"""Operators on small fixtures with known results, and on empty and odd input."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparrowlake.functions import columns as fn
from sparrowlake.operators import distribution, encoders, itemcf, metrics, missing, ordered, profiles, ranking, sampling, sparsity, splits, vectors
from sparrowlake.sources import tables

#: Made by rule: user u has two to four items.
LOG = sorted({(u, (u * u + 3 * j) % 11) for u in range(9) for j in range(2 + u % 3)})


@pytest.fixture()
def log(spark):
    return spark.createDataFrame(LOG, "user_id long, item_id long")


def test_missing_rates(spark):
    rows = [(None if i % 4 == 0 else float(i), None if i % 3 else 2.0 * i, float("nan") if i == 11 else 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r.column_name: r for r in missing.null_rates(df).collect()}
    lost = [sum(r[j] is None or r[j] != r[j] for r in rows) for j in range(3)]
    assert [round(12 * got[c].null_rate) for c in "abc"] == lost == [3, 8, 1] and got["a"].coverage == 0.75
    assert missing.overall(df).first().overall_rate == pytest.approx(sum(lost) / 36, abs=1e-4)
    assert missing.overall(df.limit(0)).first().overall_rate is None


def test_label_gap(spark):
    """x is missing in a fifth of label 0 and in all of label 1, y in the same share of both."""
    rows = [(None if i % 5 == 0 or i >= 10 else 1, None if i % 2 else 1, int(i >= 10)) for i in range(20)]
    df = spark.createDataFrame(rows, "x int, y int, label int")
    assert [(r.column_name, round(r.gap, 4)) for r in missing.label_gap(df, "label").collect()] == [("x", 0.8)]


def test_sequences(spark):
    df = spark.createDataFrame([([1, 1, 2],), ([1, 1, 1, 1],)], "s array<long>")
    assert profiles.repeat_rate(df, "s").first().repeat_rate == 0.5417
    df = spark.createDataFrame([([],), ([1, 2],), (None,)], "s array<long>")
    assert profiles.sequence_lengths(df, "s").first().empty_rate == 0.6667
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5],)], "s array<long>")
    got = df.select(fn.pad_truncate(F.col("s"), 5).alias("a"), fn.pad_truncate(F.col("s"), 3).alias("b"), fn.pad_truncate(F.col("s"), 3, "left").alias("c")).collect()
    assert (got[0].a, got[1].b, got[1].c) == ([1, 2, 3, 0, 0], [1, 2, 3], [3, 4, 5])


def test_gini_bounds(log, spark):
    g = sparsity.gini(sparsity.entity_counts(log, "item_id")).first().gini
    counts = sorted(Counter(i for _, i in LOG).values())
    n = len(counts)
    assert abs(g - (2 * sum((i + 1) * c for i, c in enumerate(counts)) / (n * sum(counts)) - (n + 1) / n)) < 1e-12
    equal = spark.createDataFrame([(i,) for i in range(9)], "item_id long")
    assert abs(sparsity.gini(sparsity.entity_counts(equal, "item_id")).first().gini) < 1e-12


def test_next_item_samples(spark):
    s = spark.createDataFrame([(1, [10, 20, 30, 40]), (2, [20, 30, 50]), (3, [10, 40, 60, 70, 80]), (4, [1]), (5, [])], "u long, items array<long>")
    got = splits.next_item_samples(s, "u", "items", maxlen=2).collect()
    assert len(got) == 9 and {(r.u, r.pos): (r.input, r.labels) for r in got}[3, 4] == ([10, 40], [40, 60])
    late = {(r.u, r.pos): (r.input, r.labels) for r in splits.next_item_samples(s, "u", "items", 2, "latest").collect()}
    assert late[3, 4] == ([60, 70], [70, 80])


def test_dense_ids(spark):
    ids = [(17 * i * i) % 1009 - 40 for i in range(30)] + [0, 2**62 + 5, 2**62 + 4, 2**40, None, None]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    want = {x: n for n, x in enumerate(sorted({x for x in ids if x}), 1)}
    assert {r.id: r.dense_id for r in splits.dense_ids(df, "id").collect()} == want


def test_number_buckets_follow_the_order(spark):
    values = [None, float("-inf"), -1e300, -2.5, -2.0, -1e-320, 0.0, 5e-324, 1e-300, 0.1, 0.1000001, 0.5, 0.99, 1.0, 3.0, 2.0**62, 1.7e308, float("inf"), float("nan")]
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", ordered.number_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) >= len(got) - 2


def similarities(log):
    """Cosine of item pairs, by dictionaries."""
    users = {}
    for u, i in log:
        users.setdefault(i, set()).add(u)
    return {(i, j): len(a & b) / math.sqrt(len(a) * len(b)) for i, a in users.items() for j, b in users.items() if i != j and a & b}


def test_item_cf(log, spark, monkeypatch):
    x = itemcf.pairs(log, "user_id", "item_id")
    want = similarities(LOG)
    for block in (2000, 1):  # one block a user, and blocks of an item or two
        monkeypatch.setattr(itemcf, "BLOCK", block)
        sim = {(r.item_i, r.item_j): r.sim for r in itemcf.cosine(x).collect()}
        assert sim.keys() == want.keys() and all(abs(sim[k] - want[k]) < 1e-12 for k in want)
    got, seen = {(r.u, r.item_id): r for r in itemcf.top_unseen(x, itemcf.cosine(x), 50).collect()}, set(LOG)
    items = {i for _, i in LOG}
    total = {(u, j): sum(want.get((i, j), 0) for v, i in LOG if v == u) for u in range(9) for j in items if (u, j) not in seen}
    assert got.keys() == {k for k, v in total.items() if v > 0} and all(abs(r.sim_sum - total[k]) < 1e-5 and r.score == 1 for k, r in got.items())
    lonely = itemcf.pairs(spark.createDataFrame([(u, 7 * u) for u in range(4)], "user_id long, item_id long"), "user_id", "item_id")
    assert itemcf.top_unseen(lonely, itemcf.cosine(lonely), 5).count() == 0
    full = itemcf.pairs(spark.createDataFrame([(u, i) for u in range(3) for i in range(4)], "user_id long, item_id long"), "user_id", "item_id")
    assert itemcf.top_unseen(full, itemcf.cosine(full), 5).count() == 0
    assert itemcf.pearson(x).count() == 0  # ratings without spread correlate with nothing


def test_negatives(log):
    own = set(LOG)
    for f in (sampling.negatives_uniform, sampling.negatives_popularity):
        got = f(log, "user_id", "item_id", n=3, tries=40).collect()
        assert len(got) == 27 and all((r.user_id, r.item_id) not in own for r in got)
        assert sorted(got) == sorted(f(log, "user_id", "item_id", n=3, tries=40).collect())


def test_negatives_of_users_with_most_items(spark):
    """Users who hold all but two of 300 items, all of them, or few: each gets its n (for each positive), own items only where it holds all."""
    rows = [(1, i) for i in range(300) if i not in (7, 250)] + [(2, i) for i in range(300)] + [(3, 5), (3, 5), (3, 9)] + [(u, 7) for u in range(10, 60)]
    log = spark.createDataFrame(rows, "user_id long, item_id long")
    held = {u: {i for v, i in rows if v == u} for u in {u for u, _ in rows}}
    for f in (sampling.negatives_uniform, sampling.negatives_popularity, sampling.negatives_mixed):
        for per_positive in (False, True):
            got = {}
            for r in f(log, "user_id", "item_id", per_positive=per_positive).collect():
                got.setdefault(r.user_id, []).append(r)
            assert {u: len(x) for u, x in got.items()} == {u: 5 * (sum(v == u for v, _ in rows) if per_positive else 1) for u in held}
            assert all(r.item_id not in held[u] for u, x in got.items() if u != 2 for r in x)
            if f is not sampling.negatives_mixed:
                assert all(sorted(r.rank for r in x) == list(range(1, len(x) + 1)) for x in got.values())
            if per_positive:
                assert {r.item_id for r in got[1]} == {7, 250}
                few = sum(r.item_id == 250 for r in got[1]) / len(got[1])
                assert abs(few - 0.5) < 0.1 if f is sampling.negatives_uniform else few < 0.4
                assert len({r.item_id for r in got[2]}) > 200


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 7, None if i % 10 == 0 else f"l{i % 3}") for i in range(1000)], "id long, item long, label string")
    got = sampling.stratified(df, "label", "id", 100).groupBy("label").count().collect()
    assert sum(r["count"] for r in got) <= 100 and len(got) == 4
    assert sampling.uniform_sample(df, "id", 10).collect() == sampling.uniform_sample(df.repartition(7), "id", 10).collect()
    assert sampling.uniform_sample(df.limit(0), "id", 10).count() == 0
    assert 50 < sampling.bernoulli(df, "id", 0.1).count() < 150


def test_splits_cover(spark):
    df = spark.createDataFrame([(i, i % 13) for i in range(997)], "id long, u long").withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 5000))
    for out in (splits.temporal(df, "ts", "id"), splits.random(df, "id")):
        assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 797, "val": 99, "test": 101}
    assert splits.temporal(df, "ts", "id").groupBy("split").agg(F.max("id").alias("m")).where("split = 'train'").first().m == 796
    per = splits.per_user(df, "u", "id").groupBy("u", "split").count().where("u = 0 AND split = 'train'").first()
    assert per["count"] == 61


def test_encoders(spark):
    a = spark.createDataFrame([("A", 1.0, 0), ("B", 2.0, 1), ("A", 3.0, 1)], "cat string, num double, label int")
    b = spark.createDataFrame([("B", 4.0), ("C", 5.0), (None, 6.0)], "cat string, num double")
    assert sorted((r.cat or "", r.frequency) for r in encoders.apply_code(b, encoders.fit_frequency(a, "cat"), "cat", "frequency").collect()) == [("", 0), ("B", 1), ("C", 0)]
    assert {r.cat: r.code for r in encoders.fit_vocabulary(a, "cat").collect()} == {"A": 1, "B": 2}
    t = {r.cat: r.encoded for r in encoders.fit_target(a, "cat", "label").collect()}
    assert abs(t["A"] - (1 + 10 * 2 / 3) / 12) < 1e-12
    assert [r.v for r in encoders.normalize(a, "num", "minmax", "v").orderBy("num").collect()] == [0.0, 0.5, 1.0]
    assert encoders.normalize(a.withColumn("num", F.lit(5.0)), "num", "minmax", "v").first().v == 0.0


def curves(rows):
    """AUC by pairs, average precision by thresholds."""
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, held = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, all_ = sum(s >= t for s in pos), sum(s >= t for _, s in rows)
        ap, held = ap + (tp - held) / len(pos) * tp / all_, tp
    return auc, ap


def test_binary_metrics(spark):
    rnd = random.Random(11)
    real = [(int(rnd.random() < 0.4), rnd.random()) for _ in range(300)]
    for rows in (real, [(y, round(s, 1)) for y, s in real], [(y, (s - 0.5) * 1e6) for y, s in real], [(y, 0.5 + s * 1e-9) for y, s in real]):
        df, (auc, ap) = spark.createDataFrame(rows, "y int, score double"), curves(rows)
        assert metrics.roc_auc(df).first().roc_auc == round(auc, 6) and metrics.average_precision(df).first().average_precision == pytest.approx(ap, abs=1e-6)
        points = sorted((r.threshold, r.fpr, r.tpr) for r in metrics.roc_curve(df).collect())
        share = lambda t, y: sum(s >= t for k, s in rows if k == y) / sum(k == y for k, _ in rows)
        assert all(f == round(share(t, 0), 6) and r == round(share(t, 1), 6) for t, f, r in points)
        area = sum((a[1] - b[1]) * (a[2] + b[2]) / 2 for a, b in zip(points, points[1:]))
        assert area == pytest.approx(auc, abs=1e-4)  # what lies between the corners is straight
    parted = spark.createDataFrame([(int(i > 6), i / 13) for i in range(13)], "y int, score double")
    assert metrics.roc_auc(parted).first().roc_auc == 1.0 and metrics.average_precision(parted).first().average_precision == 1.0
    one = spark.createDataFrame([(1, 0.7)], "y int, score double")
    assert metrics.roc_auc(one).first().roc_auc is None and metrics.suite(one).first().specificity == 0.0
    ties = spark.createDataFrame([(i % 2, 0.25) for i in range(10)], "y int, score double")
    assert metrics.roc_auc(ties).first().roc_auc == 0.5
    assert metrics.roc_auc(parted.limit(0)).count() <= 1


def test_no_window_takes_a_whole_column(spark):
    """The windows over scores and ids are parted by buckets; what is ordered in one place is a row a bucket."""
    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 7).alias("score"))
    for x in (metrics.roc_auc(df), metrics.average_precision(df), metrics.roc_curve(df), metrics.pr_curve(df), splits.dense_ids(spark.range(50), "id")):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        first = re.findall(r"windowspecdefinition\((\w+)#\d+L?( ASC| DESC)?", plan)  # a window that begins with an order has no partition
        assert first and {name for name, order in first if order} <= {"_bucket"}, first


def test_ranking(spark):
    """Three groups: hits at places 1 and 3, at place 2, and none."""
    rows = [(7, 100 + i, 1 / (i + 1), int(i in (0, 2))) for i in range(4)] + [(8, 200 + i, 5.0 - i, int(i == 1)) for i in range(6)] + [(9, 300, 0.4, 0)]
    df = spark.createDataFrame(rows, "group_id long, candidate_id long, score double, relevance int")
    got = {r.group_id: r for r in ranking.group_metrics(df, (2, 5)).collect()}
    assert set(got) == {7, 8} and (got[7].mrr, got[8].mrr) == (1.0, 0.5)
    assert got[8]["ndcg@2"] == pytest.approx(1 / math.log2(3)) and got[8]["ndcg@5"] == pytest.approx(1 / math.log2(3)) and got[7]["ndcg@5"] is None
    assert got[7]["ndcg@2"] == pytest.approx(1 / (1 + 1 / math.log2(3)))
    assert tuple(ranking.counters(df).first()) == (3, 2, 1)
    best = spark.createDataFrame([(1, i, -float(i), int(i < 3)) for i in range(8)], "group_id long, candidate_id long, score double, relevance int")
    assert ranking.group_metrics(best, (5,)).first()["ndcg@5"] == pytest.approx(1)


def test_feature_auc_reasons(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2) + i * 0.001, 5.0, None) for i in range(50)], "label int, good double, const double, nothing double")
    got = {r.column_name: (r.auc, r.reason) for r in distribution.feature_auc(df, "label", ["good", "const", "nothing"]).collect()}
    assert got == {"good": (1.0, None), "const": (None, "constant"), "nothing": (None, "all_null")}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [6.0, 8.0]), (3, [-3.0, -4.0]), (4, None)], "id long, v array<float>")
    assert [r.id for r in vectors.knn(df, df.where("id = 1"), "id", "v", 5).collect()] == [2, 3]
    assert vectors.knn(df, df.where("id = 99"), "id", "v", 5).count() == 0
    x = vectors.decode_base64(vectors.encode_base64(df, "v"), "encoded", 3).orderBy("id").collect()
    assert x[0].decoded == [3.0, 4.0, 0.0] and x[3].decoded == [0.0, 0.0, 0.0]
    bad = vectors.decode_base64(spark.createDataFrame([("??",), ("abc",)], "t string"), "t", 2).collect()
    assert all(r.decoded == [0.0, 0.0] for r in bad)


def test_functions(spark):
    import hashlib

    df = spark.createDataFrame([("a", "b", "[1, 2]", "Ab c!!d_", "-7"), ("x", "y", "oops", "__", "z")], "a string, b string, s string, n string, i string")
    got = df.select(fn.hash_cross(F.col("a"), F.col("b"), 997).alias("h"), fn.parse_sequence(F.col("s")).alias("s"), fn.sanitize(F.col("n")).alias("n"), fn.non_negative_int(F.col("i")).alias("i")).collect()
    assert got[0].h == int(hashlib.md5(b"a_X_b").hexdigest(), 16) % 997
    assert (got[0].s, got[1].s, got[0].n, got[0].i, got[1].i) == ([1, 2], None, "ab_c_d", 0, 0)
    loss = spark.range(1).select(fn.bce_with_logits(F.lit(1.0), F.lit(0.0)).alias("a"), fn.bpr_loss(F.lit(0.0), F.lit(0.0)).alias("b"), fn.huber_loss(F.lit(0.0), F.lit(3.0)).alias("c"), fn.focal_loss(F.lit(1), F.lit(0.5)).alias("d"), fn.top1_loss(F.lit(0.0), F.lit(0.0)).alias("e")).first()
    assert loss.a == pytest.approx(math.log(2)) and loss.b == pytest.approx(math.log(2)) and loss.c == 2.5 and loss.d == pytest.approx(0.25 * 0.25 * math.log(2)) and loss.e == 1.0


def test_sources(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]}), f"{tmp_path}/t.feather", compression="uncompressed")
    assert tables.load(spark, f"{tmp_path}/t.feather", ["a"]).agg(F.sum("a")).first()[0] == 6
    (tmp_path / "l.json").write_text("[[1, 2], [3], []]")
    assert [r["items"] for r in tables.json_lists(spark, f"{tmp_path}/l.json").orderBy("user_idx").collect()] == [[1, 2], [3], []]
    with pytest.raises(ValueError):
        tables.load(spark, "x.xls")
    with pytest.raises(ValueError):
        tables.materialize(spark.range(1), f"{tmp_path}/x", "orc", "gzip")
    df = spark.createDataFrame([("20000000029", [0.1, 0.2])], "anonymous_cid string, emb array<float>")
    assert tables.vector_columns(df.schema) == ("anonymous_cid", "emb")
    plan = tables.downcast_plan(spark.range(1000).selectExpr("id", "double(id) AS d", "IF(id % 2 = 0, 'A', 'B') AS c"))
    assert plan == {"id": "smallint", "d": "float", "c": "category"}
    assert "| n |" in tables.markdown("T", {"x": spark.range(2).withColumnRenamed("id", "n")})
    assert tables.charts({"x": spark.range(2), "none": spark.range(0)}).keys() == {"x"}
    tables.materialize_bucketed(spark.range(100).withColumnRenamed("id", "k"), "bucketed_t", ["k"], 4, ["k"])
    joined = spark.table("bucketed_t").join(spark.table("bucketed_t").withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"))
    assert joined.count() == 100
    spark.sql("DROP TABLE bucketed_t")


def test_overview(spark):
    from sparrowlake.operators import overview

    df = spark.createDataFrame([(1, 2, 1, 1700000000, 5, 6, [1, 2]), (1, 3, 0, 1700000001, 5, 6, [3])], "user_id long, item_id long, label_type int, timestamp long, user_int_feats_1 long, item_int_feats_1 long, domain_a_seq array<long>")
    assert {g: len(c) for g, c in overview.column_groups(df.columns).items()} == {"core": 4, "user": 1, "item": 1, "domain": 1, "other": 0}
    got = {r.metric: r.value for r in overview.overview(df).collect()}
    assert (got["rows"], got["feedback"], got["sequence"], got["modality"]) == ("2", "implicit_binary", "domain_seq", "single")
    assert overview.feature_specs(df, ["user_int_feats_1", "domain_a_seq"]) == [("user_int_feats_1", 6, 0, 1), ("domain_a_seq", 4, 1, 2)]


def test_runs(spark, sf, tmp_path):
    from sparrowlake.plans import runs
    from sparrowlake.plans.domain import interactions

    assert runs.metric_name("HR@10") == "hit@10" and runs.metric_name("AUC") == "roc_auc"
    assert runs.run_id("My Exp!", "d", "m", 3, {"b": 1, "a": 2}) == runs.run_id("my_exp", "d", "m", 3, {"a": 2, "b": 1})
    log = interactions(spark, sf).withColumnRenamed("ts", "timestamp")
    text, charts = runs.profile_report(log, "Orders")
    assert "## sparsity" in text and {"column_layout", "retention_curve", "rating_distribution"} <= set(charts)
    runs.write_results(spark.range(3), f"{tmp_path}/r")
    assert "<td>2</td>" in runs.html("T", {"x": spark.range(3)})
