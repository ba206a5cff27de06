"""Overview, mixed negatives, regression, losses and orchestrated runs as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowlake.functions import columns as fn
from sparrowlake.operators import itemcf, overview, vectors
from sparrowlake.plans import runs
from sparrowlake.plans.catalog import REGISTRY
from sparrowlake.plans.domain import LOG, events, interactions
from sparrowlake.plans.q_metrics import PRED, predictions
from sparrowlake.plans.q_sampling import _X
from sparrowlake.plans.registry import table

query = REGISTRY.query


def _facts(rows: str, size: str, facts: dict) -> str:
    return f"SELECT 'rows' AS metric, ({rows})::VARCHAR AS value UNION ALL SELECT 'bytes', ({size})::VARCHAR" + "".join(f" UNION ALL SELECT '{k}', '{v}'" for k, v in facts.items())


@query("dataset_overview", _facts("SELECT count(*) FROM events", "SELECT sum(24 + strlen(event_type) + strlen(props))::BIGINT FROM events", {"columns": 5, "core_columns": 3, "user_columns": 0, "item_columns": 0, "domain_columns": 0, "other_columns": 2, "has_label": "true", "has_timestamp": "true", "feedback": "implicit", "sequence": "none", "modality": "single"}))
def dataset_overview(spark, sf_dir):
    return overview.overview(events(spark, sf_dir).select("user_id", F.col("event_type").alias("label_type"), F.col("ts").alias("timestamp"), "value", "props"))


@query("item_regression", f"WITH {_X} SELECT a.i AS item_i, b.i AS item_j, count(*)::BIGINT AS n, round(regr_slope(b.r, a.r), 10) + 0.0::DOUBLE AS slope, round(regr_intercept(b.r, a.r), 10) + 0.0::DOUBLE AS intercept FROM x a JOIN x b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 5 AND var_pop(a.r) > 0")
def item_regression(spark, sf_dir):
    return itemcf.regression(itemcf.pairs(interactions(spark, sf_dir), "user_id", "item_id", "rating"))


@query(
    "row_losses",
    f"""WITH d AS ({PRED}), e AS (SELECT y, score AS p, ln(score / (1 - score)) AS z FROM d) SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce_logits,
round(avg(-(CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - CASE WHEN y = 1 THEN p ELSE 1 - p END, 2) * ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS focal, round(avg(CASE WHEN abs(y - p) <= 0.5 THEN 0.5 * (y - p) * (y - p) ELSE 0.5 * (abs(y - p) - 0.25) END), 6) AS huber FROM e""",
)
def row_losses(spark, sf_dir):
    y, p = F.col("y"), F.col("score")
    return predictions(spark, sf_dir).agg(F.round(F.avg(fn.bce_with_logits(y, F.log(p / (1 - p)))), 6).alias("bce_logits"), F.round(F.avg(fn.focal_loss(y, p)), 6).alias("focal"), F.round(F.avg(fn.huber_loss(y, p, 0.5)), 6).alias("huber"))


@query(
    "preprocess_encode",
    """WITH h AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), v AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS c FROM h GROUP BY 1), s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM h)
SELECT o_orderkey, coalesce(c, 0)::BIGINT AS code, round((o_totalprice - m) / greatest(d, 1e-8), 5) AS z FROM orders LEFT JOIN v USING (o_orderpriority), s""",
)
def preprocess_encode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    x = runs.encode(o.where("o_orderkey % 2 = 0"), o, ["o_orderpriority"], ["o_totalprice"])
    return x.select("o_orderkey", F.col("o_orderpriority_code").alias("code"), F.round("o_totalprice_z", 5).alias("z"))


@query("vector_lsh")
def vector_lsh(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.lsh_neighbours(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 1.2)
