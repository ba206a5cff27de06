"""Reproducible sampling: rows are ordered by a hash of seed and key, never by rand()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlake.functions.columns import cosine, md5_word, uniform
from sparrowlake.operators.ordered import ID_STEPS, hash_bucket, number_bucket, ranked, running


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the first by hash."""
    return df.withColumn("_h", md5_word(F.lit(seed), F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def stratified(df: DataFrame, label: str, key: str, budget: int, seed: int = 42) -> DataFrame:
    """max(1, floor(budget * rows of the label / rows)) rows of each label, the first by hash; null labels are a label of their own."""
    x = df.withColumn("_l", F.coalesce(F.col(label).cast("string"), F.lit("\0null"))).withColumn("_h", md5_word(F.lit(seed), F.col(key)))
    counts = x.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    quota = counts.crossJoin(F.broadcast(total)).select("_l", F.greatest(F.lit(1), F.floor(F.lit(budget) * F.col("_n") / F.col("_t"))).cast("bigint").alias("_q"))
    r = ranked(x, hash_bucket(F.col("_h")), [F.col("_h"), F.col(key)], "_r", ["_l"])
    return r.join(quota, "_l").where("_r <= _q").drop("_l", "_h", "_r", "_q")


def tail(df: DataFrame, item: str, keep: float = 0.95) -> DataFrame:
    """Rows of the items whose frequency is at most the (1 - keep) quantile of the items' frequencies."""
    freq = df.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    cut = freq.agg(F.percentile("_n", 1 - keep).alias("_c"))
    rare = freq.crossJoin(F.broadcast(cut)).where("_n <= _c").select(item)
    return df.join(rare, item, "left_semi")


def hybrid(df: DataFrame, label: str, item: str, key: str, budget: int, seed: int = 42) -> DataFrame:
    """Half of the budget stratified, then tail rows up to the rest; distinct by row key and trimmed by hash."""
    half = stratified(df, label, key, budget // 2, seed).select(*df.columns).withColumn("origin", F.lit("stratified"))
    rest = tail(df, item).select(*df.columns).withColumn("origin", F.lit("tail"))
    both = half.unionByName(rest).groupBy(*df.columns).agg(F.min("origin").alias("origin"))
    return uniform_sample(both, key, budget, seed)


def bernoulli(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Each row with the same chance, decided by its key alone."""
    return df.where(uniform(F.lit(seed), F.col(key)) < fraction)


def weighted_order(df: DataFrame, key: str, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """Weighted sample without replacement: the n smallest of -ln(u) / w."""
    return df.withColumn("_k", -F.log(uniform(F.lit(seed), F.col(key))) / weight).orderBy("_k", key).limit(n).drop("_k")


def item_pool(df: DataFrame, item: str) -> DataFrame:
    """item, freq, and idx from 0 in item order."""
    freq = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item_id")).agg(F.count(F.lit(1)).alias("freq"))
    r = ranked(freq, number_bucket(F.col("item_id"), ID_STEPS), [F.col("item_id")], "idx")
    return r.withColumn("idx", F.col("idx") - 1)


def _needs(log: DataFrame, user: str, item: str, n: int, per_positive: bool) -> DataFrame:
    """user_id, need: n a user, or n for each of its rows with an item."""
    need = F.count(F.col(item)) * n if per_positive else F.lit(n).cast("bigint")
    return log.groupBy(F.col(user).alias("user_id")).agg(need.alias("need")).where("need > 0")


def _draws(needs: DataFrame, more: int) -> DataFrame:
    return needs.select("user_id", F.explode(F.sequence(F.lit(0), F.greatest(F.col("need") + (more - 1), F.lit(0)).cast("int"))).alias("draw"))


def _first(found: DataFrame, spans: DataFrame, log: DataFrame, user: str, item: str, needs: DataFrame, seed: int) -> DataFrame:
    """Each user's first draws that are none of its own items, as many as it needs.

    What they fall short of is drawn from the items that are left to the user, without
    trial: ``spans`` (item_id, lo, w, total, width) lays the pool out in steps of integers,
    an item has w of them from lo on. A number below the steps of the items left is moved
    up by the own items that lie before it. With no item left it is a step of the whole pool.
    """
    own = log.select(F.col(user).alias("user_id"), F.col(item).alias("item_id")).distinct()
    free = found.join(own, ["user_id", "item_id"], "left_anti")
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("draw"))
    got = free.withColumn("rank", r).join(needs, "user_id").where(F.col("rank") <= F.col("need")).select("user_id", "rank", "item_id")

    short = needs.join(got.groupBy("user_id").agg(F.count(F.lit(1)).alias("have")), "user_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    held = own.join(short, "user_id", "left_semi").join(spans, "item_id")
    before = F.sum("w").over(Window.partitionBy("user_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    gaps = held.select("user_id", (F.col("lo") - F.coalesce(before, F.lit(0))).alias("at"), F.lit(None).cast("int").alias("rank"), "w")
    pool = spans.groupBy().agg(F.max("total").alias("total"), F.max("width").alias("width"))
    left = short.join(held.groupBy("user_id").agg(F.sum("w").alias("w")), "user_id", "left").crossJoin(F.broadcast(pool)).withColumn("left", F.col("total") - F.coalesce("w", F.lit(0)))
    missing = left.select("user_id", "total", "left", F.explode(F.sequence((F.col("have") + 1).cast("int"), F.col("need").cast("int"))).alias("rank"))
    word = lambda tag: md5_word(F.lit(seed), F.lit(tag), F.col("user_id"), F.col("rank"))
    number = F.shiftleft(word("high"), 31).bitwiseAND(F.lit(2**63 - 1)) + F.shiftright(word("low"), 1)
    drawn = missing.select("user_id", (number % F.when(F.col("left") > 0, F.col("left")).otherwise(F.col("total"))).alias("at"), "rank", F.lit(0).cast("bigint").alias("w"), (F.col("left") > 0).alias("moved"))
    both = gaps.withColumn("moved", F.lit(True)).unionByName(drawn)
    # own items that begin at a number move it; without an item left nothing is moved
    shift = F.sum("w").over(Window.partitionBy("user_id").orderBy("at", F.col("rank").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = both.withColumn("step", F.col("at") + F.when(F.col("moved"), shift).otherwise(F.lit(0))).where("rank IS NOT NULL").select("user_id", "rank", "step")
    cells = spans.withColumn("cell", F.explode(F.expr("sequence(lo div width, (lo + w - 1) div width)")))
    found = steps.crossJoin(F.broadcast(pool.select("width"))).withColumn("cell", F.expr("step div width")).drop("width").join(cells, "cell").where("step >= lo AND step < lo + w")
    return got.unionByName(found.select("user_id", "rank", "item_id"))


def _uniform(log: DataFrame, user: str, item: str, needs: DataFrame, more: int, seed: int) -> DataFrame:
    pool = item_pool(log, item)
    size = pool.agg(F.count(F.lit(1)).alias("size"))
    draws = _draws(needs, more).crossJoin(F.broadcast(size)).withColumn("idx", md5_word(F.lit(seed), F.col("user_id"), F.col("draw")) % F.col("size"))
    one = F.lit(1).cast("bigint")
    spans = pool.crossJoin(F.broadcast(size)).select("item_id", F.col("idx").alias("lo"), one.alias("w"), F.col("size").alias("total"), one.alias("width"))
    return _first(draws.join(pool.select("idx", "item_id"), "idx"), spans, log, user, item, needs, seed)


def _popularity(log: DataFrame, user: str, item: str, needs: DataFrame, more: int, power: float, seed: int) -> DataFrame:
    pool = item_pool(log, item).withColumn("w", F.pow(F.col("freq").cast("double"), F.lit(power))).withColumn("k", F.greatest(F.round(F.col("w") * 65536), F.lit(1.0)).cast("bigint"))
    total = pool.agg(F.sum("w").alias("total"), F.sum("k").alias("steps"))
    cells = log.agg(F.greatest(F.countDistinct(item), F.lit(1024)).alias("cells"))  # one row: as many cells as items
    cum = running(pool, number_bucket(F.col("item_id"), ID_STEPS), [F.col("item_id")], ["w", "k"]).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(cells))
    hi, lo = F.col("cum_w") / F.col("total"), (F.col("cum_w") - F.col("w")) / F.col("total")
    spans = cum.select("item_id", lo.alias("lo"), hi.alias("hi"), "cells")
    spans = spans.withColumn("cell", F.explode(F.sequence(F.greatest(F.floor(F.col("lo") * F.col("cells")) - 1, F.lit(0)), F.least(F.floor(F.col("hi") * F.col("cells")) + 1, F.col("cells") - 1)))).drop("cells")
    u = uniform(F.lit(seed), F.col("user_id"), F.col("draw"))
    draws = _draws(needs, more).withColumn("u", u).crossJoin(F.broadcast(cells)).withColumn("cell", F.floor(F.col("u") * F.col("cells")))
    found = draws.join(spans, "cell").where("u >= lo AND u < hi").select("user_id", "draw", "item_id")
    steps = cum.select("item_id", (F.col("cum_k") - F.col("k")).alias("lo"), F.col("k").alias("w"), F.col("steps").alias("total"), F.expr("steps div cells + 1").alias("width"))
    return _first(found, steps, log, user, item, needs, seed)


def negatives_uniform(log: DataFrame, user: str, item: str, n: int = 5, tries: int = 20, seed: int = 42, per_positive: bool = False) -> DataFrame:
    """user_id, rank, item_id: n items a user (or for each of its positives), drawn uniformly with replacement from the pool less its own items, or from the whole pool if it holds all."""
    return _uniform(log, user, item, _needs(log, user, item, n, per_positive), tries - n, seed)


def negatives_popularity(log: DataFrame, user: str, item: str, n: int = 5, tries: int = 20, power: float = 0.75, seed: int = 42, per_positive: bool = False) -> DataFrame:
    """As negatives_uniform, with chances proportional to freq^power: the draws meet the items' intervals of the cumulative chance, cell by cell."""
    return _popularity(log, user, item, _needs(log, user, item, n, per_positive), tries - n, power, seed)


def negatives_in_batch(rows: DataFrame, batch: str, row: str, item: str, n: int = 2, seed: int = 42) -> DataFrame:
    """row, rank, negative: up to n items of other rows of the batch (other items), by hash. Batches are of bounded size."""
    a, b = rows.select(F.col(batch).alias("b"), F.col(row).alias("row"), F.col(item).alias("item")), rows.select(F.col(batch).alias("b"), F.col(row).alias("other"), F.col(item).alias("negative"))
    pairs = a.join(b, "b").where((F.col("row") != F.col("other")) & (F.col("item") != F.col("negative")))
    r = F.row_number().over(Window.partitionBy("row").orderBy(md5_word(F.lit(seed), F.col("row"), F.col("other")), "other", "negative"))
    return pairs.withColumn("rank", r).where(F.col("rank") <= n).select("row", "rank", "negative")


def hard_negatives(vectors: DataFrame, key: str, vector: str, anchor: object, low: float, high: float) -> DataFrame:
    """key, similarity of the rows whose cosine to one anchor row lies in [low, high]."""
    one = vectors.where(F.col(key) == anchor).select(F.col(vector).alias("_q")).limit(1)  # one row is broadcast
    x = vectors.where(F.col(key) != anchor).crossJoin(F.broadcast(one)).withColumn("similarity", cosine(F.col(vector), F.col("_q")))
    return x.where(F.col("similarity").between(low, high)).select(key, F.round("similarity", 6).alias("similarity"))


def negatives_mixed(log: DataFrame, user: str, item: str, n: int = 5, uniform_share: float = 0.4, seed: int = 42, per_positive: bool = False) -> DataFrame:
    """user_id, rank, item_id, strategy: of what a user needs (see negatives_uniform) floor(need * share) are uniform draws, the rest by popularity."""
    needs = _needs(log, user, item, n, per_positive)
    a = F.floor(F.col("need") * uniform_share).cast("bigint")
    part = lambda x: needs.select("user_id", x.alias("need")).where("need > 0")
    first = _uniform(log, user, item, part(a), 20 - int(n * uniform_share), seed).withColumn("strategy", F.lit("uniform"))
    rest = _popularity(log, user, item, part(F.col("need") - a), 20 - (n - int(n * uniform_share)), 0.75, seed).withColumn("strategy", F.lit("popularity"))
    return first.unionByName(rest)
