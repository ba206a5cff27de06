"""Profiles, loaders, JDBC, sinks, vectors and schedules against plain Python."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowlake.functions import columns as fn
from sparrowlake.functions import schedules
from sparrowlake.operators import metrics, splits, vectors
from sparrowlake.plans import runs
from sparrowlake.sources import tables


@pytest.fixture(scope="module")
def wide(spark):
    """Interactions with features, domain sequences, ratings, times and a vector."""
    rows = [(i % 12, i % 7, i % 2, 1_700_000_000 + 40_000 * i, i % 5 + 1, None if i % 4 == 0 else i * 0.1, None if i % 4 == 0 or i % 2 else i, [i % 3, 1] if i % 3 else [], [i] * (i % 4), [float(i), 1.0]) for i in range(96)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, label_type int, timestamp long, rating int, user_dense_feats_1 double, item_int_feats_1 long, domain_a_seq array<long>, domain_b_seq array<long>, emb array<float>")
    return df.withColumn("timestamp", F.timestamp_seconds("timestamp"))


def test_profile_runs_every_analysis(wide):
    frames = runs.profile(wide)
    want = {"overview", "missing", "overall_missing", "co_missing", "cardinality", "cardinality_bins", "dense", "embedding_keys", "label", "null_rate_by_label", "label_gap", "feature_auc", "sequences", "repeats", "sequence_coverage"}
    want |= {"vector_norms", "vector_zeros", "vector_variance", "sparsity", "lorenz", "concentration", "long_tail", "user_cold_start", "item_cold_start", "user_histogram", "item_histogram", "user_activity", "item_popularity"}
    want |= {"domain_overlap", "rating", "user_ratings", "item_ratings", "user_bias", "item_bias", "user_bias_low", "item_bias_low", "time_span", "monthly", "daily", "retention", "gaps"}
    assert set(frames) == want and set(runs.CHARTS.values()) <= want and len(runs.CHARTS) == 26
    text, charts = runs.profile_report(wide, "All")
    assert set(charts) == set(runs.CHARTS) and all(f"## {name}\n" in text for name in want)
    lengths = {r.sequence: r["max"] for r in frames["sequences"].collect()}
    assert lengths == {"domain_a_seq": 2, "domain_b_seq": 3}
    users = [{i % 12 for i in range(96) if i % m} for m in (3, 4)]
    assert frames["domain_overlap"].first().jaccard == round(len(users[0] & users[1]) / len(users[0] | users[1]), 4)


def test_profile_of_few_columns(spark, wide):
    assert set(runs.profile(spark.range(5).withColumnRenamed("id", "x"))) == {"overview", "missing", "overall_missing", "co_missing", "cardinality", "cardinality_bins", "embedding_keys"}
    sampled = runs.profile(wide.withColumn("row", F.monotonically_increasing_id()), sample_rows=40, key="row")
    assert int({r.metric: r.value for r in sampled["overview"].collect()}["rows"]) <= 40


def test_from_raw(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa

    one, two = pd.DataFrame({"a": [1, 2]}), pa.table({"b": list(range(50))})
    assert tables.from_raw(spark, {"train": one, "seq": two})[0].columns == ["b"]
    assert tables.from_raw(spark, {"train": one, "seq": two, "dataset": [[3, 4], [], [5]]})[0].collect() == [(0, 3), (0, 4), (2, 5)]
    df, known = tables.from_raw(spark, {"note": 7, "other": two}, max_rows=10)
    assert df.count() == 10 and known == {"original_rows": 50, "sampled_at_load": True} and df.collect() == tables.from_raw(spark, {"x": two}, 10)[0].collect()
    assert tables.from_raw(spark, {"x": two}, 10, seed=1)[0].collect() != df.collect()
    spark.range(4).write.parquet(f"{tmp_path}/t.parquet")
    assert tables.from_raw(spark, {"dataset": f"{tmp_path}/t.parquet"})[0].count() == 4
    with pytest.raises(ValueError):
        tables.from_raw(spark, {"x": 1})


def test_jdbc_ranges(spark):
    """A table in an embedded database: read by a query, and in parallel ranges of its key, the largest value included."""
    url, driver = "jdbc:derby:memory:parts;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(1, 102).select(F.col("id").alias("K"), (F.col("id") * 3).alias("V")).coalesce(1).write.jdbc(url, "T", "overwrite", {"driver": driver})
    whole = tables.jdbc(spark, url, "SELECT K, V FROM T WHERE K > 90", driver=driver)
    assert whole.count() == 11 and whole.rdd.getNumPartitions() == 1
    parts = tables.jdbc(spark, url, "SELECT K, V FROM T", "K", partitions=4, fetch_size=7, driver=driver)
    assert parts.rdd.getNumPartitions() == 4 and sorted(map(tuple, parts.collect())) == [(k, 3 * k) for k in range(1, 102)]
    some = tables.jdbc(spark, url, "SELECT K FROM T", "K", (10, 20), 2, driver=driver)  # bounds deal rows to tasks, they drop none
    assert some.count() == 101


def test_subsets(spark):
    seq = spark.createDataFrame([(1, 7), (2, 8)], "user_id long, item_id long")
    user, item = spark.createDataFrame([(1, "u")], "user_id long, x string"), spark.createDataFrame([(7, "i", 5), (9, "j", 6)], "item_id long, x string, y int")
    got = tables.join_subsets({"seq": seq, "user_feat": user, "item_feat": item}).orderBy("user_id")
    assert got.columns == ["item_id", "user_id", "x", "item_feat_x", "y"]
    assert [(r.user_id, r.x, r.item_feat_x, r.y) for r in got.collect()] == [(1, "u", "i", 5), (2, None, None, None)]


def test_sequence_elements(spark):
    df = spark.createDataFrame([([(7, 1)], [(2, 3)], [4])], "a array<struct<item_id:long,w:long>>, b array<struct<z:long,c:long>>, d array<long>")
    of = lambda c, fields=None: F.transform(c, lambda x: fn.sequence_element(x, fields))
    r = df.select(of("a", ["item_id", "w"]).alias("a"), of("b", ["z", "c"]).alias("b"), of("d").alias("d")).first()
    assert (r.a, r.b, r.d) == ([7], ['{"c":3,"z":2}'], [4])


def test_fingerprint_and_predictions(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b"a,b\n" * 3000)
    found = runs.fingerprint(spark, str(path), {"k": 1})
    sample = hashlib.md5(path.read_bytes()[:4096]).hexdigest()[:16]
    parts = [str(path), "12000", str(int(path.stat().st_mtime)), sample, hashlib.md5(json.dumps({"k": 1}).encode()).hexdigest()]
    assert found == hashlib.md5("|".join(parts).encode()).hexdigest() != runs.fingerprint(spark, str(path), {"k": 2})
    df = spark.createDataFrame([("t", 1, 0.5, 1)], "task_name string, sample_id long, y_score double, y_true int")
    runs.write_predictions(df, f"{tmp_path}/p", "multitask")
    r = spark.read.parquet(f"{tmp_path}/p/predictions.parquet").first()
    assert r.asDict() == {"task_name": "t", "y_score": 0.5, "y_true": 1, "split": "test", "sample_id": 1, "y_mask": True}


def test_tensors(spark):
    df = spark.createDataFrame([([1, 2, 3], None, 4, [0.5, None], "[7, 8]", None), ([5], [6, 7], None, None, "oops", 2.5)], "s array<long>, t array<long>, user_int_1 int, user_dense_1 array<double>, user_string_1 string, user_dense_2 double")
    got = splits.flat_features(splits.tensor_sequences(df, ["s", "t"], 100), "user", 5, "f").collect()
    assert [(r.s, r.t) for r in got] == [([1, 2, 3], [0, 0, 0]), ([5, 0, 0], [6, 7, 0])]
    assert [r.f for r in got] == [[4.0, 0.5, 0.0, 7.0, 8.0], [0.0, 2.5, 0.0, 0.0, 0.0]]
    assert [r.s for r in splits.tensor_sequences(df, ["s"], 2).collect()] == [[1, 2], [5, 0]]


def test_thresholds_and_schedules():
    assert metrics.threshold_of("bundle", 0.5, [0.3, 0.4]) == 0.3 and metrics.threshold_of("bundle", 0.6) == 0.6 and metrics.threshold_of("per_task", 0.7, [0.1]) == 0.7
    with pytest.raises(ValueError):
        metrics.threshold_of("best")
    rates = schedules.plateau([1.0, 0.9, 0.9, 0.9, 0.9, 0.5, 0.6, 0.6, 0.6], 1.0, 0.1, 2)
    assert rates == pytest.approx([1, 1, 1, 1, 0.1, 0.1, 0.1, 0.1, 0.01])


def test_reports_say_that_they_are_cut(spark):
    x = {"x": spark.range(30)}
    assert "The first 10 rows" in tables.markdown("T", x, 10) and "The first" not in tables.markdown("T", x, 30)
    assert json.loads(tables.charts(x, 10)["x"])["cut"] and not json.loads(tables.charts(x, 30)["x"])["cut"]
    assert "The first 10 rows" in runs.html("T", x, 10) and "The first" not in runs.html("T", x, 30)


def test_pca_against_eigenvectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.array([r.embedding for r in e.orderBy("vec_id").select("embedding").collect()], float)
    values, axes = np.linalg.eigh(np.cov(x.T))
    components, share = vectors.pca(e, "vec_id", "embedding", 8)
    assert np.allclose(share, values[::-1][:8] / values.sum())
    got = np.array([r.components for r in components.orderBy("vec_id").collect()])
    want = (x - x.mean(0)) @ axes[:, ::-1][:, :8]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_lsh_recall(spark, sf):
    """What random-projection hashing finds of all neighbours within the distance: nothing false, and most of the true ones."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 16)), 5, 0) + 0.03 * rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in vectors.lsh_neighbours(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 0.5).collect()}
    want = {(q, i) for q in range(0, 300, 20) for i in range(300) if q != i and np.linalg.norm(x[q] - x[i]) < 0.5}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_knn_by_blocks_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(200, 4)), 1)
    x[50:60] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = {m: sorted(map(tuple, vectors.knn(df, df, "id", "v", 3, m).collect())) for m in ("cosine", "l2", "ip")}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 60)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 90)
    for m, rows in want.items():
        assert len(rows) == 600 and sorted(map(tuple, vectors.knn(df, df, "id", "v", 3, m).collect())) == rows
    near = [r.id for r in vectors.knn(df, df.where("id = 0"), "id", "v", 3, "l2").orderBy("rank").collect()]
    assert near == [50, 51, 52]


def test_losses_by_hand(spark):
    from sparrowlake.functions import losses

    r = spark.range(1).select(
        losses.cross_entropy(F.array(F.lit(1.0), F.lit(3.0)), F.lit(0)).alias("ce"), losses.info_nce(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)), F.array(F.array(F.lit(0.0), F.lit(1.0)))).alias("nce"),
        losses.info_nce(F.array(F.lit(1.0)), F.array(F.lit(2.0)), F.lit(None).cast("array<array<double>>")).alias("alone"), losses.sigmoid_focal_loss(F.lit(1.0), F.lit(0.0)).alias("focal"),
    ).first()
    assert r.ce == pytest.approx(2 + math.log1p(math.exp(-2))) and r.nce == pytest.approx(math.log1p(math.exp(-1 / 0.07))) and r.alone == pytest.approx(0) and r.focal == pytest.approx(0.25 * 0.25 * math.log(2))


def test_capabilities_and_adapters(spark, tmp_path):
    from sparrowlake.plans import interfaces

    class Small(interfaces.Dataset):
        def tables(self, spark):
            return {"note": 1, "train": spark.range(100).select((F.col("id") % 10).alias("user_id"), (F.col("id") * 7 % 9).alias("item_id"), "id")}

        def split(self, rows):
            return splits.random(rows, "id")

    parts = Small().parts(spark)
    assert {n: p.count() for n, p in parts.items()} == {"train": 80, "val": 10, "test": 10}
    model = interfaces.ItemModel().fit(parts["train"])
    assert interfaces.capabilities(model) == ["trainable", "ranker", "top_items", "stored"]
    model.save(str(tmp_path / "m"))
    again = interfaces.ItemModel().load(spark, str(tmp_path / "m"))
    users = spark.createDataFrame([(1,), (2,)], "u long")
    got = model.top_items(users, 3).collect()
    assert sorted(got) == sorted(again.top_items(users, 3).collect()) and {r.u for r in got} <= {1, 2}
    ranked = again.rank(spark.createDataFrame([(1, 0), (1, 99)], "group_id long, candidate_id long")).collect()
    assert {r.candidate_id: r.score > 0 for r in ranked} == {0: True, 99: False}


def test_index_of_reports(spark, tmp_path):
    for name in ("a/one.html", "b/two.md", "index.html", "b/x.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = runs.find_reports(spark, str(tmp_path))
    assert found == {"a/one": "a/one.html", "b/two": "b/two.md"}
    assert runs.index_page("R & D", found).count("<li>") == 2 and "R &amp; D" in runs.index_page("R & D", {})


def test_lsh_pairs_of_spark(spark, sf, monkeypatch):
    """The pairs of Spark's own join, whatever the blocks, also with repeated and missing rows; no pair is shuffled."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(vectors, "LSH_BLOCK", 7)
    monkeypatch.setattr(vectors, "LSH_PAIRS", 100)
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    e = e.unionAll(e.where("vec_id < 9")).unionAll(e.where("vec_id = 3").selectExpr("vec_id + 100000 AS vec_id", "CAST(NULL AS array<float>) AS embedding"))
    for distance, width in ((1.2, 0.5), (1.3, 0.05)):
        x = e.where("embedding IS NOT NULL").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
        model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=4, bucketLength=width, seed=42).fit(x)
        joined = model.approxSimilarityJoin(x.where("vec_id % 5 = 0"), x, distance, distCol="d").where("datasetA.vec_id <> datasetB.vec_id")
        want = sorted((r.a, r.b, r.d) for r in joined.selectExpr("datasetA.vec_id AS a", "datasetB.vec_id AS b", "round(d, 6) AS d").collect())
        found = vectors.lsh_neighbours(e, e.where("vec_id % 5 = 0"), "vec_id", "embedding", distance, width=width)
        assert sorted(map(tuple, found.collect())) == want and want
        plain = vectors.lsh_neighbours(e.limit(0), e, "vec_id", "embedding", distance)
        assert plain.count() == 0 and plain.columns == found.columns
    once = e.where("vec_id >= 9")
    assert "Exchange" not in vectors.lsh_neighbours(once, once.where("vec_id % 5 = 0"), "vec_id", "embedding", 1.2)._jdf.queryExecution().executedPlan().toString()
