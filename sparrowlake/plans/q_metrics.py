"""Evaluation metrics, ranking metrics, experiment results and vectors, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowlake.operators import itemcf, metrics, ranking, results, splits, vectors
from sparrowlake.plans.catalog import REGISTRY
from sparrowlake.plans.domain import LOG, interactions
from sparrowlake.plans.q_sampling import unseen_sql
from sparrowlake.plans.registry import table

query = REGISTRY.query

#: Binary predictions: whether a line was returned, and a score with ties.
PRED = "SELECT (l_returnflag = 'R')::INTEGER AS y, l_quantity / 51.0::DOUBLE AS score, l_tax + 0.5::DOUBLE AS weight, l_linestatus AS task, l_discount < 0.08 AS mask FROM lineitem"


def predictions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 51.0).alias("score"), (F.col("l_tax") + 0.5).alias("weight"), F.col("l_linestatus").alias("task"), (F.col("l_discount") < 0.08).alias("mask"))


def _cells(hit: str = "score >= 0.5") -> str:
    return ", ".join(f"sum(({a} AND {b})::INTEGER)::BIGINT AS {n}" for n, a, b in (("tp", "y = 1", hit), ("fp", "y = 0", hit), ("tn", "y = 0", f"NOT {hit}"), ("fn", "y = 1", f"NOT {hit}")))


_SUITE = """round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0), 6) AS npv, round(1 - coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6) AS fpr, round(1 - coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS fnr, round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy"""


@query("confusion", f"WITH d AS ({PRED}), c AS (SELECT {_cells()} FROM d) SELECT *, round((tp + fn)::DOUBLE / (tp + fp + tn + fn), 6) AS prevalence FROM c")
def confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


@query("classification_suite", f"WITH d AS ({PRED}), c AS (SELECT {_cells()} FROM d) SELECT {_SUITE} FROM c")
def classification_suite(spark, sf_dir):
    return metrics.suite(predictions(spark, sf_dir))


@query("threshold_sweep", f"WITH d AS ({PRED}), t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, {_cells('score >= threshold')} FROM d, t GROUP BY threshold) SELECT threshold, {_SUITE} FROM c")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(predictions(spark, sf_dir), [0.1, 0.3, 0.5, 0.7, 0.9])


@query("log_loss_brier", f"WITH d AS ({PRED}) SELECT round(avg(-(y * ln(greatest(least(score, 1 - 1e-10), 1e-10)) + (1 - y) * ln(1 - greatest(least(score, 1 - 1e-10), 1e-10)))), 6) AS log_loss, round(avg((score - y) * (score - y)), 6) AS brier FROM d")
def log_loss_brier(spark, sf_dir):
    return metrics.log_loss_brier(predictions(spark, sf_dir))


@query("weighted_accuracy", f"WITH d AS ({PRED}) SELECT round(sum(weight * ((score >= 0.5)::INTEGER = y)::INTEGER) / sum(weight), 6) AS weighted_accuracy, round(sum(weight * (score - y) * (score - y)) / sum(weight), 6) AS weighted_brier FROM d")
def weighted_accuracy(spark, sf_dir):
    return metrics.weighted(predictions(spark, sf_dir))


_AUC = "(sum(CASE WHEN y = 1 THEN rk END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / nullif(sum(y)::DOUBLE * (count(*) - sum(y)), 0)"
_RANK = "rank() OVER ({p}ORDER BY score) + (count(*) OVER (PARTITION BY {q}score) - 1) / 2.0::DOUBLE AS rk"
_STEPS = "h AS (SELECT {k}score, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg FROM d GROUP BY {k}score), t AS (SELECT {k}score, pos, sum(pos) OVER ({p}ORDER BY score DESC)::BIGINT AS tp, sum(neg) OVER ({p}ORDER BY score DESC)::BIGINT AS fp, sum(pos) OVER ({w})::BIGINT AS p, sum(neg) OVER ({w})::BIGINT AS n FROM h)"
_ALL = _STEPS.format(k="", p="", w="")
_AP = "round(sum(pos::DOUBLE / p * tp / (tp + fp)), 6) AS average_precision"


@query("roc_auc", f"WITH d AS ({PRED}), r AS (SELECT y, {_RANK.format(p='', q='')} FROM d) SELECT round({_AUC}, 6) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(predictions(spark, sf_dir))


@query("average_precision", f"WITH d AS ({PRED}), {_ALL} SELECT {_AP} FROM t")
def average_precision(spark, sf_dir):
    return metrics.average_precision(predictions(spark, sf_dir))


@query(
    "roc_curve",
    f"""WITH d AS ({PRED}), {_ALL}, s AS (SELECT *, fp - lag(fp, 1, 0) OVER o AS x1, tp - lag(tp, 1, 0) OVER o AS y1, lead(fp) OVER o - fp AS x2, lead(tp) OVER o - tp AS y2 FROM t WINDOW o AS (ORDER BY score DESC))
SELECT 'infinity'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT score, round(fp::DOUBLE / n, 6), round(tp::DOUBLE / p, 6) FROM s WHERE coalesce(x1 * y2 <> x2 * y1, true)""",
)
def roc_curve(spark, sf_dir):
    return metrics.roc_curve(predictions(spark, sf_dir))


@query("pr_curve", f"WITH d AS ({PRED}), {_ALL} SELECT score AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / p, 6) AS recall FROM t UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE")
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(predictions(spark, sf_dir))


_CLASSES = "SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 'R' WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END AS p FROM lineitem"


@query(
    "multiclass_macro",
    f"""WITH d AS ({_CLASSES}), k AS (SELECT t AS c FROM d UNION SELECT p FROM d), x AS (SELECT c, (SELECT count(*) FROM d WHERE t = c AND p = c)::DOUBLE AS hit, (SELECT count(*) FROM d WHERE t = c)::DOUBLE AS s, (SELECT count(*) FROM d WHERE p = c)::DOUBLE AS q FROM k),
m AS (SELECT *, coalesce(hit / nullif(q, 0), 0) AS pr, coalesce(hit / nullif(s, 0), 0) AS re, coalesce(2 * hit / nullif(s + q, 0), 0) AS f1 FROM x)
SELECT round(sum(hit) / sum(s), 6) AS accuracy, round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro, round(2 * sum(hit) / (sum(s) + sum(q)), 6) AS f1_micro, round(sum(f1 * s) / sum(s), 6) AS f1_weighted FROM m""",
)
def multiclass_macro(spark, sf_dir):
    p = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25), "R").when(F.col("l_linestatus") == "F", "A").otherwise("N")
    return metrics.multiclass_macro(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("t"), p.alias("p")), "t", "p")


_TASKS = f"WITH d AS (SELECT task, y, score FROM ({{src}}) z WHERE mask), {_STEPS.format(k='task, ', p='PARTITION BY task ', w='PARTITION BY task')}, ap AS (SELECT task, {_AP} FROM t GROUP BY task), r AS (SELECT task, y, score, {_RANK.format(p='PARTITION BY task ', q='task, ')} FROM d), a AS (SELECT task, round({_AUC}, 6) AS roc_auc FROM r GROUP BY task), c AS (SELECT task, {_cells()} FROM d GROUP BY task), o AS (SELECT c.task, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, roc_auc, average_precision FROM c JOIN a ON a.task = c.task JOIN ap ON ap.task = c.task)"


@query("multitask_masked", _TASKS.format(src=PRED) + " SELECT * FROM o")
def multitask_masked(spark, sf_dir):
    return metrics.by_task(predictions(spark, sf_dir))


_LABELS = "SELECT 'quality' AS task, quality AS y, n_chars / 40000.0::DOUBLE + 0.4 AS score, true AS mask FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'toxic', toxic, n_chars / 20000.0::DOUBLE, true FROM labels JOIN documents USING (doc_id)"


@query("multilabel_macro", _TASKS.format(src=_LABELS) + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_macro" for c in ("accuracy", "f1", "roc_auc", "average_precision")) + " FROM o")
def multilabel_macro(spark, sf_dir):
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    one = lambda name, score: F.struct(F.lit(name).alias("task"), F.col(name).alias("y"), score.alias("score"), F.lit(True).alias("mask"))
    long = x.select(F.explode(F.array(one("quality", F.col("n_chars") / 40000.0 + 0.4), one("toxic", F.col("n_chars") / 20000.0))).alias("t")).select("t.*")
    return metrics.macro(metrics.by_task(long))


# ranking: a customer is a group, its lines are candidates

RANK = "SELECT o_custkey AS group_id, l_orderkey * 100000 + l_partkey AS candidate_id, round(l_extendedprice, 0) AS score, (l_returnflag = 'R' AND l_discount > 0.06)::INTEGER AS relevance FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("group_id"))
    l = table(spark, sf_dir, "lineitem")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("group_id", (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("candidate_id"), F.round("l_extendedprice", 0).alias("score"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.06)).cast("int").alias("relevance"))


def ranking_sql(src: str, total: str = "sum(relevance) OVER (PARTITION BY group_id)") -> str:
    """CTEs ending in g: the metrics of each group that has a relevant candidate."""
    per = []
    for k in (5, 10):
        ideal = f"(SELECT sum(1 / log2(i + 1)) FROM range(1, {k + 1}) v(i) WHERE i <= max(total))"
        has = f"CASE WHEN max(n) >= {k} THEN "
        per += [f"{has}sum(CASE WHEN rank <= {k} THEN hit / log2(rank + 1) ELSE 0 END) / {{ideal{k}}} END AS \"ndcg@{k}\"", f"{has}least(sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END), 1)::DOUBLE END AS \"hit@{k}\"", f"{has}sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END)::DOUBLE / max(total) END AS \"recall@{k}\"", f"{has}sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END)::DOUBLE / {k} END AS \"precision@{k}\""]
    ideals = {f"ideal{k}": "(CASE least(max(total), " + str(k) + ") " + " ".join(f"WHEN {m} THEN " + "+".join(f"1 / log2({i + 1})" for i in range(1, m + 1)) for m in range(1, k + 1)) + " END)" for k in (5, 10)}
    body = ", ".join(per).format(**ideals)
    return f"""src AS ({src}), o AS (SELECT *, relevance AS hit, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, candidate_id) AS rank, count(*) OVER (PARTITION BY group_id) AS n, {total} AS total FROM src),
h AS (SELECT *, sum(hit) OVER (PARTITION BY group_id ORDER BY rank) AS hits FROM o),
g AS (SELECT group_id, max(n)::BIGINT AS candidates, max(total)::BIGINT AS relevant, coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN rank END), 0) AS mrr, sum(CASE WHEN hit = 1 THEN hits::DOUBLE / rank ELSE 0 END) / max(total) AS map, {body} FROM h WHERE total > 0 GROUP BY group_id)"""


_NAMES = ["mrr", "map", *(f"{m}@{k}" for k in (5, 10) for m in ("ndcg", "hit", "recall", "precision"))]
_SUMMARY = " UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg(\"{n}\"), 6) AS value, round(stddev_pop(\"{n}\"), 6) AS std, count(\"{n}\")::BIGINT AS group_count FROM g" for n in _NAMES)


def _groups(names: list[str]):
    def f(spark, sf_dir):
        return ranking.group_metrics(candidates(spark, sf_dir)).select("group_id", *(F.round(f"`{n}`", 6).alias(n.replace("@", "_at_")) for n in names))

    return f


for _name, _cols in (("ndcg_at_k", ["ndcg@5", "ndcg@10"]), ("mrr", ["mrr"]), ("hit_recall_precision_at_k", ["hit@10", "recall@10", "precision@10"]), ("map", ["map"])):
    query(_name, f"WITH {ranking_sql(RANK)} SELECT group_id, " + ", ".join(f"round(\"{n}\", 6) AS {n.replace('@', '_at_')}" for n in _cols) + " FROM g")(_groups(_cols))


@query("ranking_summary", f"WITH {ranking_sql(RANK)} {_SUMMARY}")
def ranking_summary(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return ranking.summary(c, ranking.group_metrics(c))


@query("ranking_counters", f"WITH s AS (SELECT group_id, max(relevance) AS ok FROM ({RANK}) z GROUP BY 1) SELECT count(*)::BIGINT AS num_groups, sum(ok)::BIGINT AS num_valid, (count(*) - sum(ok))::BIGINT AS num_skipped FROM s")
def ranking_counters(spark, sf_dir):
    return ranking.counters(candidates(spark, sf_dir))


@query("metrics_by_k", f"WITH {ranking_sql(RANK)} " + " UNION ALL ".join(f"SELECT {k} AS k, " + ", ".join(f"round(avg(\"{m}@{k}\"), 6) AS {m}" for m in ("ndcg", "hit", "recall", "precision")) + " FROM g" for k in (5, 10)))
def metrics_by_k(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return ranking.by_k(ranking.summary(c, ranking.group_metrics(c)))


_E2E_X = f"z AS ({LOG}), train AS (SELECT * FROM z WHERE ts < '1997-01-01'::TIMESTAMP), x AS (SELECT user_id AS u, item_id AS i, 1.0::DOUBLE AS r FROM train GROUP BY 1, 2), pop AS (SELECT i, count(*)::DOUBLE AS d FROM x GROUP BY 1), held AS (SELECT DISTINCT user_id AS u, item_id AS i FROM z WHERE ts >= '1997-01-01'::TIMESTAMP)"
_E2E = "SELECT rec.u AS group_id, rec.item_id AS candidate_id, (-rank)::DOUBLE AS score, (held.i IS NOT NULL)::INTEGER AS relevance, t.total AS tot FROM rec JOIN (SELECT u, count(*) AS total FROM held GROUP BY 1) t ON t.u = rec.u LEFT JOIN held ON held.u = rec.u AND held.i = rec.item_id"


@query("itemcf_end_to_end", f"WITH {unseen_sql(_E2E_X)}, {ranking_sql(_E2E, 'tot')} {_SUMMARY}")
def itemcf_end_to_end(spark, sf_dir):
    """Split by time, fit item similarities, take the best unseen items, and rank against what users did next."""
    log, cut = interactions(spark, sf_dir), F.lit("1997-01-01").cast("timestamp_ntz")
    x = itemcf.pairs(log.where(F.col("ts") < cut), "user_id", "item_id")
    held = log.where(F.col("ts") >= cut).select(F.col("user_id").alias("group_id"), F.col("item_id").alias("candidate_id")).distinct().withColumn("relevance", F.lit(1))
    totals = held.groupBy("group_id").agg(F.count(F.lit(1)).alias("total"))
    rec = itemcf.top_unseen(x, itemcf.cosine(x, 20), 10).select(F.col("u").alias("group_id"), F.col("item_id").alias("candidate_id"), (-F.col("rank")).cast("double").alias("score"))
    flat = rec.join(totals.select("group_id"), "group_id", "left_semi").join(held, ["group_id", "candidate_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    return ranking.summary(flat, ranking.group_metrics(flat, relevant=totals))


# experiment results: brands are models, return flags datasets, line numbers seeds

RUNS = "SELECT p_brand AS model, l_returnflag AS dataset, l_linenumber AS seed, CASE WHEN sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status, round(avg(l_discount), 6) AS metric, round(avg(l_quantity), 4) AS duration FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3"


def runs(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    open_ = F.sum((F.col("l_linestatus") == "O").cast("int"))
    return x.groupBy(F.col("p_brand").alias("model"), F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("seed")).agg(F.when(open_ % 3 == 0, "failed").otherwise("succeeded").alias("status"), F.round(F.avg("l_discount"), 6).alias("metric"), F.round(F.avg("l_quantity"), 4).alias("duration"))


_MATRIX = "m AS (SELECT DISTINCT p_brand AS model FROM part), d AS (SELECT DISTINCT l_returnflag AS dataset FROM lineitem), s AS (SELECT unnest([1, 2, 3, 8]) AS seed)"


def _lists(spark, sf_dir):
    return (
        table(spark, sf_dir, "part").select(F.col("p_brand").alias("model")).distinct(), table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset")).distinct(),
        spark.range(1).select(F.explode(F.array(*map(F.lit, (1, 2, 3, 8)))).alias("seed")),
    )


_CONFIG = "substr(sha256('{\"dataset\":\"' || dataset || '\",\"model\":\"' || model || '\",\"seed\":' || seed || '}'), 1, 8)"


@query("experiment_matrix", f"WITH {_MATRIX} SELECT model, dataset, seed, {_CONFIG} AS config_hash, 'exp__' || dataset || '__' || model || '__seed' || seed || '__' || {_CONFIG} AS run_id FROM m, d, s")
def experiment_matrix(spark, sf_dir):
    return results.matrix(*_lists(spark, sf_dir))


@query("resume_plan", f"WITH {_MATRIX}, r AS ({RUNS}) SELECT m.model, d.dataset, s.seed, coalesce(status, 'missing') AS status, CASE WHEN status = 'succeeded' THEN 'skip' ELSE 'run' END AS action FROM m CROSS JOIN d CROSS JOIN s LEFT JOIN r ON r.model = m.model AND r.dataset = d.dataset AND r.seed = s.seed")
def resume_plan(spark, sf_dir):
    plan = results.matrix(*_lists(spark, sf_dir)).select("model", "dataset", "seed")
    return results.resume_plan(plan, runs(spark, sf_dir).select("model", "dataset", "seed", "status"))


@query("leaderboard", f"WITH r AS ({RUNS}), g AS (SELECT model, dataset, count(*)::BIGINT AS runs, round(avg(metric), 9) AS mean, round(coalesce(stddev_samp(metric), 0), 9) AS std FROM r WHERE status = 'succeeded' GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY mean DESC, model, dataset)::INTEGER AS rank FROM g")
def leaderboard(spark, sf_dir):
    return results.leaderboard(runs(spark, sf_dir))


@query("stability", f"WITH r AS ({RUNS}) SELECT model, dataset, count(DISTINCT seed)::BIGINT AS seeds, round(avg(metric), 9) AS mean, round(stddev_samp(metric), 9) AS std, round(abs(stddev_samp(metric) / nullif(avg(metric), 0)), 9) AS cv, min(metric) AS min, max(metric) AS max FROM r WHERE status = 'succeeded' GROUP BY 1, 2 HAVING count(DISTINCT seed) >= 2")
def stability(spark, sf_dir):
    return results.stability(runs(spark, sf_dir))


@query("trend", f"WITH r AS ({RUNS}) SELECT model, seed, round(avg(metric), 9) AS metric, round(sum(duration), 4) AS duration FROM r WHERE status = 'succeeded' GROUP BY 1, 2")
def trend(spark, sf_dir):
    return results.trend(runs(spark, sf_dir))


@query("failures", f"WITH r AS ({RUNS}) SELECT model, dataset, count(*)::BIGINT AS failed_runs, min(seed)::INTEGER AS first_seed FROM r WHERE status = 'failed' GROUP BY 1, 2")
def failures(spark, sf_dir):
    return results.failures(runs(spark, sf_dir))


@query("speedup_report", f"WITH r AS ({RUNS}) SELECT model, count(*)::BIGINT AS runs, round(avg(duration), 6) AS mean_duration, min(duration) AS min_duration, max(duration) AS max_duration, round((SELECT min(duration) FROM r) / avg(duration), 6) AS speedup FROM r GROUP BY 1")
def speedup_report(spark, sf_dir):
    return results.speedup(runs(spark, sf_dir))


@query("overall_status", f"WITH r AS ({RUNS}) SELECT dataset, CASE WHEN avg((status = 'succeeded')::INTEGER) = 1 THEN 'succeeded' WHEN avg((status = 'succeeded')::INTEGER) > 0 THEN 'partial_success' ELSE 'failed' END AS overall FROM r GROUP BY 1")
def overall_status(spark, sf_dir):
    return results.overall_status(runs(spark, sf_dir))


# vectors

_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_LEN = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_SCORES = {
    "cosine": f"{_DOT} / ({_LEN.format('a')} * {_LEN.format('b')})",
    "l2": "-sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))))",
    "ip": _DOT,
}


def _knn(metric: str):
    def f(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings")
        return vectors.knn(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, metric)

    return f


for _metric, _expr in _SCORES.items():
    query(f"vector_topk_{_metric}", f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, {_expr} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM p) SELECT query_id, rank::INTEGER AS rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 5")(_knn(_metric))


@query("vector_mean_std", "SELECT (i - 1)::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[i]::DOUBLE), 6) AS std FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) z GROUP BY i")
def vector_mean_std(spark, sf_dir):
    return vectors.mean_std(table(spark, sf_dir, "embeddings"), "embedding")


@query("l2_normalized", f"SELECT vec_id, i::INTEGER AS dim, round(a.embedding[i + 1]::DOUBLE / greatest({_LEN.format('a')}, 1e-10), 6) AS x FROM embeddings a, range(0, 64) v(i)")
def l2_normalized(spark, sf_dir):
    x = vectors.normalized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return x.select("vec_id", F.posexplode("unit").alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


@query("base64_roundtrip", "SELECT vec_id, 64 AS dims, true AS same FROM embeddings")
def base64_roundtrip(spark, sf_dir):
    x = vectors.decode_base64(vectors.encode_base64(table(spark, sf_dir, "embeddings"), "embedding"), "encoded", 64)
    return x.select("vec_id", F.size("decoded").alias("dims"), F.forall(F.zip_with("embedding", "decoded", lambda a, b: a == b), lambda x: x).alias("same"))


@query("pca_explained")
def pca_explained(spark, sf_dir):
    _, share = vectors.pca(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(share)], "component int, explained double")
