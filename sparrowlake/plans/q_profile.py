"""Profile queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.operators import distribution, missing, profiles, sparsity
from sparrowlake.plans.catalog import REGISTRY
from sparrowlake.plans.domain import LOG, WIDE, events, interactions, wide
from sparrowlake.plans.registry import table

query = REGISTRY.query
WIDE_COLUMNS = ["doc_id", "chars", "lang", "source", "user_int_key", "quality", "toxic"]


def _union(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query(
    "sparsity_gini",
    f"""WITH x AS ({LOG}), c AS (SELECT item_id, count(*) AS y FROM x GROUP BY item_id),
r AS (SELECT y, row_number() OVER (ORDER BY y, item_id) AS i, count(*) OVER () AS n, sum(y) OVER () AS s FROM c)
SELECT (SELECT count(*) FROM x)::BIGINT AS interactions, (SELECT count(DISTINCT user_id) FROM x)::BIGINT AS users, max(n)::BIGINT AS items,
round(1 - (SELECT count(*) FROM x)::DOUBLE / ((SELECT count(DISTINCT user_id) FROM x)::DOUBLE * max(n)), 6) AS sparsity,
round(2 * sum(i * y)::DOUBLE / (max(n) * max(s))::DOUBLE - (max(n) + 1)::DOUBLE / max(n), 4) AS gini FROM r""",
)
def sparsity_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparsity.matrix_profile(interactions(spark, sf_dir), "user_id", "item_id")


@query("column_null_rates", f"WITH w AS ({WIDE}) " + _union("SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INTEGER), 4)::DOUBLE AS null_rate, round(1 - round(avg(({c} IS NULL)::INTEGER), 4), 4)::DOUBLE AS coverage FROM w", WIDE_COLUMNS))
def column_null_rates(spark, sf_dir):
    return missing.null_rates(wide(spark, sf_dir))


@query("overall_missing", f"WITH w AS ({WIDE}), s AS (SELECT count(*) AS n, " + "+".join(f"sum(({c} IS NULL)::INTEGER)" for c in WIDE_COLUMNS) + " AS m FROM w) SELECT n::BIGINT AS row_count, (n * 7)::BIGINT AS cells, m::BIGINT AS nulls, round(m::DOUBLE / (n * 7), 4) AS overall_rate FROM s")
def overall_missing(spark, sf_dir):
    return missing.overall(wide(spark, sf_dir))


@query(
    "co_missing_pairs",
    f"WITH w AS ({WIDE}), r AS ("
    + _union("SELECT '{c}' AS c, round(avg(({c} IS NULL)::INTEGER), 4) AS rate FROM w", WIDE_COLUMNS)
    + "), p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(avg(({a} IS NULL AND {b} IS NULL)::INTEGER), 4)::DOUBLE AS rate FROM w" for i, a in enumerate(WIDE_COLUMNS) for b in WIDE_COLUMNS[i + 1 :])
    + ") SELECT p.* FROM p JOIN r x ON x.c = column_a JOIN r y ON y.c = column_b WHERE x.rate > 0.05 AND x.rate < 0.95 AND y.rate > 0.05 AND y.rate < 0.95 AND p.rate > 0 ORDER BY p.rate DESC, column_a, column_b LIMIT 10",
)
def co_missing_pairs(spark, sf_dir):
    return missing.co_missing(wide(spark, sf_dir))


_BY_LABEL = f"w AS ({WIDE}), r AS (" + _union("SELECT quality AS label, '{c}' AS column_name, round(avg(({c} IS NULL)::INTEGER), 4)::DOUBLE AS null_rate FROM w WHERE quality IS NOT NULL GROUP BY quality", [c for c in WIDE_COLUMNS if c != "quality"]) + ")"


@query("null_rate_by_label", f"WITH {_BY_LABEL} SELECT * FROM r")
def null_rate_by_label(spark, sf_dir):
    return missing.null_rate_by_label(wide(spark, sf_dir), "quality")


@query("label_null_gap", f"WITH {_BY_LABEL} SELECT column_name, round(max(null_rate) - min(null_rate), 4) AS gap FROM r GROUP BY column_name HAVING round(max(null_rate) - min(null_rate), 4) >= 0.05 ORDER BY gap DESC, column_name LIMIT 15")
def label_null_gap(spark, sf_dir):
    return missing.label_gap(wide(spark, sf_dir), "quality")


@query("suspected_embedding_cols", f"WITH w AS ({WIDE}) SELECT 'user_int_key' AS column_name, round(avg((user_int_key IS NULL)::INTEGER), 4)::DOUBLE AS null_rate, count(DISTINCT user_int_key)::BIGINT AS distinct_values FROM w HAVING avg((user_int_key IS NULL)::INTEGER) > 0.8 AND count(DISTINCT user_int_key) > 10")
def suspected_embedding_cols(spark, sf_dir):
    w = wide(spark, sf_dir)
    return missing.suspected_embeddings(w, [c for c in w.columns if c.startswith(("user_int_", "item_int_"))])


@query("label_distribution", "SELECT event_type AS value, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 4) AS share FROM events GROUP BY event_type")
def label_distribution(spark, sf_dir):
    return distribution.shares(events(spark, sf_dir), "event_type")


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


@query("feature_cardinality", _union("SELECT '{c}' AS column_name, count(DISTINCT {c})::BIGINT AS distinct_values FROM lineitem", _LINE))
def feature_cardinality(spark, sf_dir):
    return distribution.cardinality(table(spark, sf_dir, "lineitem"), _LINE)


@query("cardinality_bins", "WITH d AS (" + _union("SELECT count(DISTINCT {c}) AS d FROM lineitem", _LINE) + ") SELECT CASE WHEN d <= 10 THEN '1-10' WHEN d <= 100 THEN '11-100' WHEN d <= 1000 THEN '101-1K' WHEN d <= 10000 THEN '1K-10K' WHEN d <= 100000 THEN '10K-100K' ELSE '100K+' END AS bin, count(*)::BIGINT AS columns FROM d WHERE d > 0 GROUP BY 1")
def cardinality_bins(spark, sf_dir):
    return distribution.cardinality_bins(table(spark, sf_dir, "lineitem"), _LINE)


_DENSE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("dense_stats", _union("SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max, round(skewness({c}), 4) AS skew, round(sum(({c} = 0)::INTEGER)::DOUBLE / count(*), 4) AS zero_rate FROM lineitem", _DENSE))
def dense_stats(spark, sf_dir):
    return distribution.dense_stats(table(spark, sf_dir, "lineitem"), _DENSE)


_AUC = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CASE WHEN min(x0) = max(x0) OR min(x0) IS NULL THEN NULL ELSE round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / nullif(sum(y)::DOUBLE * (count(*) - sum(y)), 0), 4) END AS auc,
CASE WHEN min(x0) IS NULL THEN 'all_null' WHEN min(x0) = max(x0) THEN 'constant' END AS reason
FROM (SELECT y, x0, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rk FROM (SELECT quality AS y, {e}::DOUBLE AS x0, coalesce({e}::DOUBLE, (SELECT median({e}::DOUBLE) FROM w WHERE quality IS NOT NULL)) AS x FROM w WHERE quality IS NOT NULL) a) b"""
    for c, e in (("chars", "chars"), ("toxic", "toxic"), ("user_int_key", "user_int_key"), ("constant", "constant"))
)


@query("feature_auc", f"WITH w AS (SELECT *, 5 AS constant FROM ({WIDE}) z) {_AUC}")
def feature_auc(spark, sf_dir):
    return distribution.feature_auc(wide(spark, sf_dir).withColumn("constant", F.lit(5)), "quality", ["chars", "toxic", "user_int_key", "constant"])


@query("column_stats", _union("SELECT '{c}' AS column_name, count(DISTINCT {c})::BIGINT AS distinct_values, (count(*) - count({c}))::BIGINT AS nulls, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4)::DOUBLE AS mean, round(stddev_samp({c}), 4) AS std FROM lineitem", ["l_partkey", "l_linenumber", *_DENSE]))
def column_stats(spark, sf_dir):
    return distribution.column_stats(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber", *_DENSE])


@query("top_values", "SELECT l_partkey AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, value LIMIT 1000")
def top_values(spark, sf_dir):
    return distribution.top_values(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("rating_distribution", f"WITH x AS ({LOG}) SELECT rating AS value, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM x), 4) AS share FROM x GROUP BY rating")
def rating_distribution(spark, sf_dir):
    return distribution.shares(interactions(spark, sf_dir), "rating")


_POINTS = ", ".join(f"round(quantile_cont(m, {p / 100}), 4)::DOUBLE AS p{p}" for p in (25, 50, 75, 95))


@query("user_mean_rating_stats", f"WITH u AS (SELECT user_id, avg(rating) AS m FROM ({LOG}) x GROUP BY user_id) SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std, {_POINTS} FROM u")
def user_mean_rating_stats(spark, sf_dir):
    return profiles.mean_rating_stats(interactions(spark, sf_dir), "user_id", "rating")


@query("item_mean_rating_stats", f"WITH u AS (SELECT item_id, avg(rating) AS m FROM ({LOG}) x GROUP BY item_id) SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std, {_POINTS} FROM u")
def item_mean_rating_stats(spark, sf_dir):
    return profiles.mean_rating_stats(interactions(spark, sf_dir), "item_id", "rating")


def _bias(key: str, order: str) -> str:
    return f"WITH x AS ({LOG}) SELECT {key} AS entity, round(avg(rating) - (SELECT round(avg(rating), 4) FROM x), 4) AS bias FROM x GROUP BY {key} ORDER BY bias {order}, entity LIMIT 10"


@query("user_bias_top", _bias("user_id", "DESC"))
def user_bias_top(spark, sf_dir):
    return profiles.bias(interactions(spark, sf_dir), "user_id", "rating")


@query("item_bias_bottom", _bias("item_id", "ASC"))
def item_bias_bottom(spark, sf_dir):
    return profiles.bias(interactions(spark, sf_dir), "item_id", "rating", descending=False)


@query("rating_density", f"WITH u AS (SELECT user_id, count(*) AS m FROM ({LOG}) x GROUP BY user_id) SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std, {_POINTS} FROM u")
def rating_density(spark, sf_dir):
    return profiles.rating_density(interactions(spark, sf_dir), "user_id")


def _activity(key: str) -> str:
    points = ", ".join(f"round(quantile_cont(n, {p / 100}), 2)::DOUBLE AS p{p}" for p in (50, 75, 95, 99))
    return f"WITH u AS (SELECT {key}, count(*) AS n FROM ({LOG}) x GROUP BY {key}) SELECT round(avg(n), 2) AS mean, {points}, max(n)::BIGINT AS max, count(*)::BIGINT AS entities, sum(n)::BIGINT AS total FROM u"


@query("user_activity", _activity("user_id"))
def user_activity(spark, sf_dir):
    return profiles.activity_stats(interactions(spark, sf_dir), "user_id")


@query("item_popularity", _activity("item_id"))
def item_popularity(spark, sf_dir):
    return profiles.activity_stats(interactions(spark, sf_dir), "item_id")


@query(
    "activity_histogram",
    f"""WITH u AS (SELECT user_id, count(*) AS n FROM ({LOG}) x GROUP BY user_id), m AS (SELECT max(n) AS mx, greatest(1, ceil(max(n) / 10.0)) AS w FROM u),
b AS (SELECT least(floor(n / w), ceil(mx / w) - 1)::BIGINT AS bin, w::BIGINT AS w FROM u, m) SELECT bin, (bin * w) || '-' || (bin * w + w - 1) AS label, count(*)::BIGINT AS entities FROM b GROUP BY bin, w""",
)
def activity_histogram(spark, sf_dir):
    return profiles.activity_histogram(interactions(spark, sf_dir), "user_id")


@query(
    "lorenz_curve",
    f"""WITH u AS (SELECT item_id, count(*) AS n FROM ({LOG}) x GROUP BY item_id), h AS (SELECT n, count(*) AS e FROM u GROUP BY n)
SELECT n::BIGINT AS n, round(sum(e) OVER (ORDER BY n)::DOUBLE / (SELECT sum(e) FROM h), 6) AS population_share, round(sum(e * n) OVER (ORDER BY n)::DOUBLE / (SELECT sum(e * n) FROM h), 6) AS count_share FROM h""",
)
def lorenz_curve(spark, sf_dir):
    return profiles.lorenz_curve(interactions(spark, sf_dir), "item_id")


@query("cold_start", f"WITH u AS (SELECT item_id, count(*) AS n FROM ({LOG}) x GROUP BY item_id), t AS (SELECT quantile_cont(n, 0.05)::DOUBLE AS threshold FROM u) SELECT threshold, round(avg((n <= threshold)::INTEGER), 4) AS cold_ratio FROM u, t GROUP BY threshold")
def cold_start(spark, sf_dir):
    return profiles.cold_start(interactions(spark, sf_dir), "item_id")


_RANKED = f"u AS (SELECT user_id, count(*) AS n FROM ({LOG}) x GROUP BY user_id), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, user_id) AS i, count(*) OVER () AS c, sum(n) OVER () AS s FROM u)"


@query("concentration", f"WITH {_RANKED} " + " UNION ALL ".join(f"SELECT {p} AS percent, greatest(1, floor(max(c) * {p} / 100.0))::BIGINT AS k, round(sum(CASE WHEN i <= greatest(1, floor(c * {p} / 100.0)) THEN n ELSE 0 END)::DOUBLE / max(s), 4) AS share FROM r" for p in (1, 5, 10)))
def concentration(spark, sf_dir):
    return profiles.concentration(interactions(spark, sf_dir), "user_id")


@query("long_tail", f"WITH u AS (SELECT item_id, count(*) AS n FROM ({LOG}) x GROUP BY item_id), r AS (SELECT n, row_number() OVER (ORDER BY n, item_id) AS i, count(*) OVER () AS c, sum(n) OVER () AS s FROM u) SELECT (max(c) // 2)::BIGINT AS tail_entities, round(sum(CASE WHEN i <= c // 2 THEN n ELSE 0 END)::DOUBLE / max(s), 4) AS coverage FROM r")
def long_tail(spark, sf_dir):
    return profiles.long_tail(interactions(spark, sf_dir), "item_id")


@query(
    "cross_domain_overlap",
    """WITH s AS (SELECT DISTINCT event_type AS d, user_id AS u FROM events), n AS (SELECT d, count(*) AS n FROM s GROUP BY d), p AS (SELECT a.d AS a, b.d AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.d < b.d),
c AS (SELECT x.d AS a, y.d AS b, count(*) AS c FROM s x JOIN s y ON x.u = y.u AND x.d < y.d GROUP BY 1, 2)
SELECT p.a AS domain_a, p.b AS domain_b, coalesce(c, 0)::BIGINT AS common, round(coalesce(c, 0)::DOUBLE / (na + nb - coalesce(c, 0)), 4) AS jaccard FROM p LEFT JOIN c ON p.a = c.a AND p.b = c.b""",
)
def cross_domain_overlap(spark, sf_dir):
    return profiles.cross_domain_overlap(events(spark, sf_dir), "user_id", "event_type")


@query("time_span", "SELECT strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::BIGINT AS span_days FROM events")
def time_span(spark, sf_dir):
    return profiles.time_span(events(spark, sf_dir), "ts")


@query("monthly_volume", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def monthly_volume(spark, sf_dir):
    return profiles.monthly_volume(table(spark, sf_dir, "orders"), "o_orderdate")


@query("daily_peak", "WITH d AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1) SELECT count(*)::BIGINT AS active_days, round(avg(n), 1) AS daily_mean, max(n)::BIGINT AS daily_peak FROM d")
def daily_peak(spark, sf_dir):
    return profiles.daily_peak(events(spark, sf_dir), "ts")


@query("retention_curve", "WITH l AS (SELECT user_id, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS life FROM events GROUP BY 1) SELECT d.d::INTEGER AS day, round(avg((life >= d.d)::INTEGER), 4) AS ratio FROM l, range(1, 31) d(d) GROUP BY 1 HAVING round(avg((life >= d.d)::INTEGER), 4) > 0")
def retention_curve(spark, sf_dir):
    return profiles.retention_curve(events(spark, sf_dir), "user_id", "ts")


@query("interaction_gaps", "WITH g AS (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9 AS h FROM events) SELECT round(avg(h), 1) AS mean_hours, round(quantile_cont(h, 0.5), 1) AS p50_hours, round(quantile_cont(h, 0.95), 1) AS p95_hours, round(max(h), 1) AS max_hours FROM g")
def interaction_gaps(spark, sf_dir):
    return profiles.interaction_gaps(events(spark, sf_dir), "user_id", "ts", "event_id")


_SEQ = "s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS items FROM events GROUP BY user_id)"


def sequences(spark, sf_dir):
    return profiles.user_sequences(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@query("sequence_lengths", f"WITH {_SEQ}, n AS (SELECT len(items) AS n FROM s) SELECT round(avg(n), 2) AS mean, round(stddev_pop(n), 2) AS std, " + ", ".join(f"round(quantile_cont(n, {p / 100}), 2)::DOUBLE AS p{p}" for p in (50, 95, 99)) + ", min(n)::INTEGER AS min, max(n)::INTEGER AS max, round(avg((n = 0)::INTEGER), 4) AS empty_rate FROM n")
def sequence_lengths(spark, sf_dir):
    return profiles.sequence_lengths(sequences(spark, sf_dir), "items")


@query("repeat_rate", f"WITH {_SEQ} SELECT round(avg(1 - len(list_distinct(items))::DOUBLE / len(items)), 4) AS repeat_rate, count(*)::BIGINT AS sequences FROM s")
def repeat_rate(spark, sf_dir):
    return profiles.repeat_rate(sequences(spark, sf_dir), "items")


@query("sequence_coverage", f"SELECT count(DISTINCT item_id)::BIGINT AS distinct_items, count(*)::BIGINT AS total_items FROM ({LOG}) x")
def sequence_coverage(spark, sf_dir):
    return profiles.sequence_coverage(profiles.user_sequences(interactions(spark, sf_dir), "user_id", ["ts", "row_id"], "item_id"), "items")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("vector_norms", f"WITH n AS (SELECT {_NORM} AS n FROM embeddings) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, " + ", ".join(f"round(quantile_cont(n, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 95)) + ", round(min(n), 6) AS min, round(max(n), 6) AS max FROM n")
def vector_norms(spark, sf_dir):
    return profiles.vector_norms(table(spark, sf_dir, "embeddings"), "embedding")


@query("zero_duplicate_vectors", "WITH g AS (SELECT list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS r, count(*) AS n, sum(CASE WHEN list_max(list_transform(embedding, lambda x: abs(x))) = 0 THEN 1 ELSE 0 END) AS z FROM embeddings GROUP BY 1) SELECT sum(n)::BIGINT AS vectors, sum(z)::BIGINT AS zero_vectors, round(sum(z)::DOUBLE / sum(n), 4) AS zero_ratio, round(1 - count(*)::DOUBLE / sum(n), 4) AS duplicate_ratio FROM g")
def zero_duplicate_vectors(spark, sf_dir):
    return profiles.zero_and_duplicate_vectors(table(spark, sf_dir, "embeddings"), "embedding")


_DIMS = "d AS (SELECT unnest(range(1, 65)) AS i, embedding FROM embeddings), m AS (SELECT i, avg(embedding[i]::DOUBLE) AS mean, var_pop(embedding[i]::DOUBLE) AS v FROM d GROUP BY i)"


@query("dim_variance", f"WITH {_DIMS} SELECT round(avg(v), 6) AS mean_variance, round(min(v), 6) AS min_variance, round(max(v), 6) AS max_variance, round(avg(abs(mean)), 6) AS mean_abs_mean, count(*)::BIGINT AS dims FROM m")
def dim_variance(spark, sf_dir):
    return profiles.dimension_variance(table(spark, sf_dir, "embeddings"), "embedding")
