"""Sampling, splits, encoders and item-based collaborative filtering, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowlake.functions import columns as fn
from sparrowlake.operators import encoders, itemcf, profiles, sampling, splits
from sparrowlake.plans.catalog import REGISTRY
from sparrowlake.plans.domain import LOG, events, interactions
from sparrowlake.plans.registry import table

query = REGISTRY.query


def word(*parts: str) -> str:
    """SQL for the first 32 bits of md5 of the parts joined by ':'."""
    return "('0x' || substr(md5(" + " || ':' || ".join(f"{p}::VARCHAR" for p in parts) + "), 1, 8))::BIGINT"


def uniform(*parts: str) -> str:
    return f"(({word(*parts)})::DOUBLE + 0.5) / 4294967296.0::DOUBLE"


_STRAT = f"""h AS (SELECT *, {word("'42'", 'event_id')} AS h FROM events), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
q AS (SELECT event_type, greatest(1, floor(500 * n / (SELECT count(*) FROM events)::DOUBLE)) AS q FROM c),
r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS r FROM h)"""


@query("uniform_sample", f"SELECT event_id, user_id, event_type FROM events ORDER BY {word(chr(39) + '42' + chr(39), 'event_id')}, event_id LIMIT 500")
def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(events(spark, sf_dir).select("event_id", "user_id", "event_type"), "event_id", 500)


@query("stratified_sample", f"WITH {_STRAT} SELECT event_id, user_id, r.event_type FROM r JOIN q ON r.event_type = q.event_type WHERE r <= q")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(events(spark, sf_dir).select("event_id", "user_id", "event_type"), "event_type", "event_id", 500)


_TAIL = "f AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT user_id FROM f WHERE n <= (SELECT quantile_cont(n, 0.05) FROM f))"


@query("tail_sample", f"WITH {_TAIL} SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM t)")
def tail_sample(spark, sf_dir):
    return sampling.tail(events(spark, sf_dir).select("event_id", "user_id", "event_type"), "user_id")


@query(
    "hybrid_sample",
    f"""WITH {_STRAT.replace('500', '250')}, {_TAIL}, b AS (SELECT event_id, user_id, r.event_type, 'stratified' AS origin FROM r JOIN q ON r.event_type = q.event_type WHERE r <= q
UNION ALL SELECT event_id, user_id, event_type, 'tail' FROM events WHERE user_id IN (SELECT user_id FROM t)), g AS (SELECT event_id, user_id, event_type, min(origin) AS origin FROM b GROUP BY 1, 2, 3)
SELECT * FROM g ORDER BY {word("'42'", 'event_id')}, event_id LIMIT 500""",
)
def hybrid_sample(spark, sf_dir):
    return sampling.hybrid(events(spark, sf_dir).select("event_id", "user_id", "event_type"), "event_type", "user_id", "event_id", 500)


@query("bernoulli_sample", f"SELECT event_id FROM events WHERE {uniform(chr(39) + '42' + chr(39), 'event_id')} < 0.1")
def bernoulli_sample(spark, sf_dir):
    return sampling.bernoulli(events(spark, sf_dir).select("event_id"), "event_id", 0.1)


_POOL = f"x AS ({LOG}), pool AS (SELECT item_id, count(*) AS freq, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM x GROUP BY item_id), own AS (SELECT DISTINCT user_id, item_id FROM x), d AS (SELECT user_id, unnest(range(0, 20)) AS draw FROM (SELECT DISTINCT user_id FROM x))"
_FIRST = "r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY draw) AS rank FROM n WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = n.user_id AND o.item_id = n.item_id)) SELECT user_id, rank::INTEGER AS rank, item_id FROM r WHERE rank <= 5"


@query("item_pool", f"WITH {_POOL} SELECT item_id, freq::BIGINT AS freq, idx::BIGINT AS idx FROM pool")
def item_pool(spark, sf_dir):
    return sampling.item_pool(interactions(spark, sf_dir), "item_id")


@query("negatives_uniform", f"WITH {_POOL}, n AS (SELECT user_id, draw, item_id FROM d JOIN pool ON idx = {word(chr(39) + '42' + chr(39), 'user_id', 'draw')} % (SELECT count(*) FROM pool)), {_FIRST}")
def negatives_uniform(spark, sf_dir):
    return sampling.negatives_uniform(interactions(spark, sf_dir), "user_id", "item_id")


@query(
    "negatives_popularity",
    f"""WITH {_POOL}, w AS (SELECT item_id, pow(freq::DOUBLE, 0.75) AS w FROM pool), c AS (SELECT item_id, (sum(w) OVER (ORDER BY item_id) - w) / (SELECT sum(w) FROM w) AS lo, sum(w) OVER (ORDER BY item_id) / (SELECT sum(w) FROM w) AS hi FROM w),
u AS (SELECT user_id, draw, {uniform("'42'", 'user_id', 'draw')} AS u FROM d), n AS (SELECT user_id, draw, item_id FROM u JOIN c ON u >= lo AND u < hi), {_FIRST}""",
)
def negatives_popularity(spark, sf_dir):
    return sampling.negatives_popularity(interactions(spark, sf_dir), "user_id", "item_id")


@query(
    "negatives_in_batch",
    f"""WITH x AS (SELECT l_orderkey AS b, l_orderkey * 10 + l_linenumber AS "row", l_partkey AS item FROM lineitem), p AS (SELECT a."row" AS "row", c.item AS negative, row_number() OVER (PARTITION BY a."row" ORDER BY {word("'42'", 'a."row"', 'c."row"')}, c."row", c.item) AS rank
FROM x a JOIN x c ON a.b = c.b AND a."row" <> c."row" AND a.item <> c.item) SELECT "row", rank::INTEGER AS rank, negative FROM p WHERE rank <= 2""",
)
def negatives_in_batch(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), "l_partkey")
    return sampling.negatives_in_batch(x, "l_orderkey", "row", "l_partkey")


_COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"


@query("hard_negatives", f"WITH p AS (SELECT a.vec_id, {_COS} AS s FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0) SELECT vec_id, round(s, 6) AS similarity FROM p WHERE s BETWEEN 0.1 AND 0.3")
def hard_negatives(spark, sf_dir):
    return sampling.hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0, 0.1, 0.3)


@query("weighted_order_sample", f"SELECT p_partkey, p_retailprice FROM part ORDER BY -ln({uniform(chr(39) + '42' + chr(39), 'p_partkey')}) / p_retailprice, p_partkey LIMIT 200")
def weighted_order_sample(spark, sf_dir):
    return sampling.weighted_order(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey", F.col("p_retailprice"), 200)


def _split(order: str, where: str = "", n: str = "(SELECT count(*) FROM x)") -> str:
    return f"CASE WHEN r <= floor({n} * 0.8::DOUBLE) THEN 'train' WHEN r <= floor({n} * 0.8::DOUBLE) + floor({n} * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split"


@query("temporal_split", f"WITH x AS ({LOG}), r AS (SELECT row_id, row_number() OVER (ORDER BY ts, row_id) AS r FROM x) SELECT row_id, {_split('')} FROM r")
def temporal_split(spark, sf_dir):
    return splits.temporal(interactions(spark, sf_dir).select("row_id", "ts"), "ts", "row_id").select("row_id", "split")


@query("random_split", f"WITH x AS (SELECT event_id FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY {word(chr(39) + '42' + chr(39), 'event_id')}, event_id) AS r FROM x) SELECT event_id, {_split('')} FROM r")
def random_split(spark, sf_dir):
    return splits.random(events(spark, sf_dir).select("event_id"), "event_id")


@query("per_user_split", f"WITH x AS ({LOG}), r AS (SELECT user_id, row_id, row_number() OVER (PARTITION BY user_id ORDER BY {word(chr(39) + '42' + chr(39), 'row_id')}, row_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM x) SELECT user_id, row_id, {_split('', n='n')} FROM r")
def per_user_split(spark, sf_dir):
    return splits.per_user(interactions(spark, sf_dir).select("user_id", "row_id"), "user_id", "row_id")


@query(
    "cumulative_split",
    "WITH u AS (SELECT user_id, count(*) - 1 AS positions FROM events GROUP BY 1), c AS (SELECT *, sum(positions) OVER (ORDER BY user_id) AS cum, (SELECT sum(positions) FROM u)::DOUBLE AS t FROM u) SELECT user_id, positions::BIGINT AS positions, CASE WHEN cum <= floor(t * 0.8::DOUBLE) THEN 'train' WHEN cum <= floor(t * 0.8::DOUBLE) + floor(t * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM c",
)
def cumulative_split(spark, sf_dir):
    u = events(spark, sf_dir).groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("positions"))
    return splits.cumulative(u, "user_id", "positions")


_SEQ = "s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS items, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY 1), p AS (SELECT *, unnest(range(1, len(items))) AS pos FROM s WHERE len(items) >= 2)"


def sequences(spark, sf_dir):
    return profiles.user_sequences(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


def _samples(keep: str) -> str:
    a = "1" if keep == "earliest" else "greatest(pos - 19, 1)"
    return f"WITH {_SEQ} SELECT user_id, pos::INTEGER AS pos, array_to_string(items[{a}:{a} + least(pos, 20) - 1], ',') AS input, array_to_string(items[{a} + 1:{a} + least(pos, 20)], ',') AS labels FROM p"


def _joined(df):
    return df.withColumn("input", F.array_join("input", ",")).withColumn("labels", F.array_join("labels", ","))


@query("next_item_samples", _samples("earliest"))
def next_item_samples(spark, sf_dir):
    return _joined(splits.next_item_samples(sequences(spark, sf_dir), "user_id", "items"))


@query("next_item_samples_latest", _samples("latest"))
def next_item_samples_latest(spark, sf_dir):
    return _joined(splits.next_item_samples(sequences(spark, sf_dir), "user_id", "items", keep="latest"))


@query(
    "structured_samples",
    f"""WITH x AS ({LOG}), s AS (SELECT user_id, list(item_id ORDER BY ts, row_id, item_id, rating) AS items, list(rating ORDER BY ts, row_id, item_id, rating) AS actions FROM x GROUP BY 1), p AS (SELECT *, unnest(range(1, len(items))) AS pos FROM s WHERE len(items) >= 2)
SELECT user_id, pos::INTEGER AS pos, least(pos, 20)::INTEGER AS length, array_to_string(actions[1:least(pos, 20)], ',') AS actions, c_mktsegment AS segment, coalesce(p_size, 0)::INTEGER AS item_size
FROM p LEFT JOIN customer ON c_custkey = user_id LEFT JOIN part ON p_partkey = items[least(pos, 20)]""",
)
def structured_samples(spark, sf_dir):
    row = F.struct("ts", "row_id", "item_id", "rating")
    s = interactions(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("seq"))
    x = splits.next_item_samples(s, "user_id", "seq").select("user_id", "pos", F.size("input").alias("length"), F.array_join(F.transform("input", lambda e: e["rating"].cast("string")), ",").alias("actions"), F.element_at("input", -1)["item_id"].alias("last"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("last"), F.col("p_size").alias("item_size"))
    return x.join(users, "user_id", "left").join(items, "last", "left").select("user_id", "pos", "length", "actions", "segment", F.coalesce("item_size", F.lit(0)).alias("item_size"))


@query("flat_pairs", "SELECT user_id, event_type AS item_id, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def flat_pairs(spark, sf_dir):
    return splits.flat_pairs(sequences(spark, sf_dir), "user_id", "items").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("min_sequence_length", f"WITH {_SEQ} SELECT user_id, len(items)::INTEGER AS length FROM s WHERE len(items) >= 60")
def min_sequence_length(spark, sf_dir):
    return splits.min_length(sequences(spark, sf_dir), "items", 60).select("user_id", F.size("items").alias("length"))


@query("min_action_filter", f"WITH x AS ({LOG}) SELECT user_id, count(*)::INTEGER AS length FROM x WHERE rating >= 4 GROUP BY 1 HAVING count(*) >= 10")
def min_action_filter(spark, sf_dir):
    s = interactions(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("item_id", "rating")).alias("seq"))
    return splits.min_action(s, "seq", "rating", 4, 10).select("user_id", F.size("seq").alias("length"))


@query("dense_id_map", "SELECT l_partkey AS id, row_number() OVER (ORDER BY l_partkey)::BIGINT AS dense_id FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey <> 0)")
def dense_id_map(spark, sf_dir):
    return splits.dense_ids(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(
    "pad_truncate",
    f"WITH x AS ({LOG}), s AS (SELECT user_id, list(item_id ORDER BY ts, row_id, item_id) AS items FROM x GROUP BY 1) SELECT user_id, array_to_string(list_resize(items[1:30], 30, 0), ',') AS head, array_to_string(list_concat(list_resize([]::BIGINT[], greatest(30 - len(items), 0), 0), items[greatest(len(items) - 29, 1):]), ',') AS tail FROM s",
)
def pad_truncate(spark, sf_dir):
    s = profiles.user_sequences(interactions(spark, sf_dir), "user_id", ["ts", "row_id"], "item_id")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return splits.padded(s, "user_id", "items", 30).select("user_id", text("head"), text("tail"))


# encoders: fitted on one half of the rows, applied to all

_HALF = "h AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0)"


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return o, o.where("o_orderkey % 2 = 0")


@query("frequency_encode", f"WITH {_HALF}, f AS (SELECT o_custkey, count(*) AS n FROM h GROUP BY 1) SELECT o_orderkey, coalesce(n, 0)::BIGINT AS frequency FROM orders LEFT JOIN f USING (o_custkey)")
def frequency_encode(spark, sf_dir):
    o, h = _orders(spark, sf_dir)
    return encoders.apply_code(o, encoders.fit_frequency(h, "o_custkey"), "o_custkey", "frequency").select("o_orderkey", "frequency")


@query(
    "target_encode",
    f"WITH {_HALF}, g AS (SELECT avg((o_orderstatus = 'F')::INTEGER::DOUBLE) AS g FROM h), f AS (SELECT o_custkey, (sum((o_orderstatus = 'F')::INTEGER) + 10 * (SELECT g FROM g)) / (count(*) + 10) AS e FROM h GROUP BY 1) SELECT o_orderkey, round(coalesce(e, (SELECT g FROM g)), 6) AS encoded FROM orders LEFT JOIN f USING (o_custkey)",
)
def target_encode(spark, sf_dir):
    o, h = _orders(spark, sf_dir)
    label = (F.col("o_orderstatus") == "F").cast("int")
    fitted = encoders.fit_target(h.withColumn("y", label), "o_custkey", "y")
    overall = h.agg(F.avg(label.cast("double")).alias("g"))
    x = o.join(fitted, "o_custkey", "left").crossJoin(F.broadcast(overall))
    return x.select("o_orderkey", F.round(F.coalesce("encoded", "g"), 6).alias("encoded"))


@query("category_vocab", f"WITH {_HALF}, v AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS code FROM h GROUP BY 1 ORDER BY code LIMIT 200) SELECT o_orderkey, coalesce(code, 0)::BIGINT AS code FROM orders LEFT JOIN v USING (o_custkey)")
def category_vocab(spark, sf_dir):
    o, h = _orders(spark, sf_dir)
    return encoders.apply_code(o, encoders.fit_vocabulary(h, "o_custkey", 200), "o_custkey", "code").select("o_orderkey", "code")


def _normal(how: str):
    def f(spark, sf_dir):
        return encoders.normalize(_orders(spark, sf_dir)[0], "o_totalprice", how, "v").select("o_orderkey", F.round("v", 6).alias("v"))

    return f


query("minmax", "WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT o_orderkey, round((o_totalprice - a) / (b - a), 6) AS v FROM orders, s")(_normal("minmax"))
query("zscore", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders) SELECT o_orderkey, round((o_totalprice - m) / greatest(d, 1e-8), 6) AS v FROM orders, s")(_normal("zscore"))
query("log1p_norm", "SELECT o_orderkey, round(ln(1 + greatest(o_totalprice, 0)), 6) AS v FROM orders")(_normal("log1p"))

_MD5 = "md5(l_partkey::VARCHAR || '_X_' || l_suppkey::VARCHAR)"


def _fold(m: int) -> str:
    out = "0::BIGINT"
    for i in range(4):
        out = f"(({out} * 4294967296 + ('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT) % {m})"
    return out


@query("hash_cross", f"WITH x AS (SELECT l_orderkey, l_linenumber, {_MD5} AS d FROM lineitem) SELECT l_orderkey, l_linenumber, {_fold(1000000)}::BIGINT AS crossed FROM x")
def hash_cross(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.hash_cross(F.col("l_partkey"), F.col("l_suppkey")).alias("crossed"))


@query(
    "embedding_dims",
    "SELECT l_partkey AS id, CASE WHEN l_partkey <= 1 THEN 1 ELSE least(greatest(round_even(2 * pow(l_partkey::DOUBLE, 0.25), 0), 1), 600) END::BIGINT AS google, CASE WHEN l_partkey <= 1 THEN 1 ELSE greatest(1, least(50, floor(1.6 * pow(l_partkey::DOUBLE, 0.25)), l_partkey // 2)) END::BIGINT AS fastai, CASE WHEN l_partkey <= 1 THEN 1 ELSE least(50, floor(sqrt(l_partkey::DOUBLE))) END::BIGINT AS thumb, CASE WHEN l_partkey <= 1 THEN 1 ELSE least(50, l_partkey - 1) END::BIGINT AS other FROM (SELECT DISTINCT l_partkey FROM lineitem)",
)
def embedding_dims(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    return x.select("id", *(fn.embedding_dim(F.col("id"), r).alias(n) for r, n in (("google", "google"), ("fastai", "fastai"), ("rule_of_thumb", "thumb"), ("other", "other"))))


# item-based collaborative filtering

_X = f"x AS (SELECT user_id AS u, item_id AS i, avg(rating::DOUBLE) AS r FROM ({LOG}) z GROUP BY 1, 2), pop AS (SELECT i, count(*)::DOUBLE AS d FROM x GROUP BY 1)"


def _top(sim: str, k: int, pre: str = "", norm: bool = False) -> str:
    """SQL: the k best of a table sim (item_i, item_j, sim) that holds both directions."""
    s = "sim / max(sim) OVER (PARTITION BY item_i)" if norm else "sim"
    return f"WITH {_X}{pre}, sim AS ({sim}), t AS (SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY round(sim, 9) DESC, item_j) AS rank FROM sim), k AS (SELECT * FROM t WHERE rank <= {k}) SELECT item_i, item_j, round({s}, 6) AS sim FROM k"


_COSINE = "SELECT a.i AS item_i, b.i AS item_j, count(*) / sqrt(any_value(p.d) * any_value(q.d)) AS sim FROM x a JOIN x b ON a.u = b.u AND a.i <> b.i JOIN pop p ON p.i = a.i JOIN pop q ON q.i = b.i GROUP BY 1, 2"
_IUF = "SELECT a.i AS item_i, b.i AS item_j, sum(1 / (ln(1 + n.n::DOUBLE) * ln(1 + n.n::DOUBLE))) / sqrt(any_value(p.d) * any_value(q.d)) AS sim FROM x a JOIN x b ON a.u = b.u AND a.i <> b.i JOIN n ON n.u = a.u JOIN pop p ON p.i = a.i JOIN pop q ON q.i = b.i GROUP BY 1, 2"
_ADJ = "SELECT a.i AS item_i, b.i AS item_j, sum(a.v * b.v) / sqrt(any_value(p.d) * any_value(q.d)) AS sim FROM c a JOIN c b ON a.u = b.u AND a.i <> b.i JOIN s p ON p.i = a.i JOIN s q ON q.i = b.i GROUP BY 1, 2"
_PEARSON = "SELECT a.i AS item_i, b.i AS item_j, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS sim FROM c a JOIN c b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(a.v * a.v) > 1e-12 AND sum(b.v * b.v) > 1e-12"


def _rated(spark, sf_dir):
    return itemcf.pairs(interactions(spark, sf_dir), "user_id", "item_id", "rating")


def _out(sim):
    return sim.select("item_i", "item_j", F.round("sim", 6).alias("sim"))


@query("cooccurrence", f"WITH {_X} SELECT a.i AS item_i, b.i AS item_j, count(*)::BIGINT AS together FROM x a JOIN x b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2")
def cooccurrence(spark, sf_dir):
    return itemcf.cooccurrence(_rated(spark, sf_dir))


@query("sim_cosine", _top(_COSINE, 10))
def sim_cosine(spark, sf_dir):
    return _out(itemcf.cosine(_rated(spark, sf_dir), 10))


@query("sim_iuf", _top(_IUF, 10, ", n AS (SELECT u, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 2)"))
def sim_iuf(spark, sf_dir):
    return _out(itemcf.iuf(_rated(spark, sf_dir), 10))


@query("sim_adjusted_cosine", _top(_ADJ, 10, ", m AS (SELECT u, avg(r) AS m FROM x GROUP BY 1), c AS (SELECT x.u, i, r - m AS v FROM x JOIN m USING (u)), s AS (SELECT i, sum(v * v) AS d FROM c GROUP BY 1 HAVING sum(v * v) > 1e-12)"))
def sim_adjusted_cosine(spark, sf_dir):
    return _out(itemcf.adjusted_cosine(_rated(spark, sf_dir), 10))


@query("sim_pearson", _top(_PEARSON, 10, ", m AS (SELECT i, avg(r) AS m FROM x GROUP BY 1), c AS (SELECT u, x.i, r - m AS v FROM x JOIN m ON m.i = x.i)"))
def sim_pearson(spark, sf_dir):
    return _out(itemcf.pearson(_rated(spark, sf_dir), 10))


@query("sim_row_normalized", _top(_COSINE, 10, norm=True))
def sim_row_normalized(spark, sf_dir):
    return _out(itemcf.cosine(_rated(spark, sf_dir), 10, normed=True))


def unseen_sql(x: str, k: int = 10, neighbours: int = 20) -> str:
    """CTEs ending in rec (u, rank, item_id, score, sim_sum) for a table x(u, i, r)."""
    return f"""{x}, sim AS ({_COSINE}), t AS (SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY round(sim, 9) DESC, item_j) AS rank FROM sim), k AS (SELECT * FROM t WHERE rank <= {neighbours}),
s AS (SELECT u, item_j AS item_id, round(sum(sim) / sum(abs(sim)), 6) AS score, round(sum(abs(sim)), 6) AS sim_sum FROM x JOIN k ON item_i = i GROUP BY 1, 2),
f AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.u = s.u AND x.i = s.item_id)), placed AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, sim_sum DESC, item_id) AS rank FROM f), rec AS (SELECT * FROM placed WHERE rank <= {k})"""


@query("unseen_topk", f"WITH {unseen_sql(_X)} SELECT u, rank::INTEGER AS rank, item_id, score, sim_sum FROM rec")
def unseen_topk(spark, sf_dir):
    x = _rated(spark, sf_dir)
    return itemcf.top_unseen(x, itemcf.cosine(x, 20), 10)


@query("merge_cooccurrence", f"WITH {_X} SELECT a.i AS item_i, b.i AS item_j, count(*)::BIGINT AS together FROM x a JOIN x b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2")
def merge_cooccurrence(spark, sf_dir):
    """Incremental fit: the counts of two halves of the users, merged."""
    x = _rated(spark, sf_dir)
    return itemcf.merge_cooccurrence(itemcf.cooccurrence(x.where("u % 2 = 0")), itemcf.cooccurrence(x.where("u % 2 = 1")))
