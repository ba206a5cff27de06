"""Rating, activity, temporal, sequence and vector profiles of interaction data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlake.functions.columns import histogram_bin, norm
from sparrowlake.operators.sparsity import count_histogram, entity_counts


def spread(x: str, places: int, points: tuple[float, ...], std: bool = True) -> list[Column]:
    """mean, population std, exact interpolated percentiles and max of a column, rounded."""
    out = [F.round(F.avg(x), places).alias("mean")]
    if std:
        out.append(F.round(F.stddev_pop(x), places).alias("std"))
    return out + [F.round(F.percentile(x, p), places).alias(f"p{round(p * 100)}") for p in points]


# ratings


def mean_rating_stats(df: DataFrame, key: str, rating: str) -> DataFrame:
    """Spread of the entities' mean ratings."""
    return df.groupBy(key).agg(F.avg(rating).alias("m")).agg(*spread("m", 4, (0.25, 0.5, 0.75, 0.95)))


def bias(df: DataFrame, key: str, rating: str, top: int = 10, descending: bool = True) -> DataFrame:
    """The entities whose mean rating differs most from the (4-decimal) global mean, upwards or downwards."""
    overall = df.agg(F.round(F.avg(rating), 4).alias("g"))
    x = df.groupBy(F.col(key).alias("entity")).agg(F.avg(rating).alias("m")).crossJoin(F.broadcast(overall)).select("entity", F.round(F.col("m") - F.col("g"), 4).alias("bias"))
    return x.orderBy(F.desc("bias") if descending else F.asc("bias"), "entity").limit(top)


def rating_density(df: DataFrame, user: str) -> DataFrame:
    """Spread of the number of ratings a user gives."""
    return entity_counts(df, user).agg(*spread("n", 4, (0.25, 0.5, 0.75, 0.95)))


# activity and popularity


def activity_stats(df: DataFrame, key: str) -> DataFrame:
    """mean, p50, p75, p95, p99, max of the rows an entity has, entities and rows."""
    return entity_counts(df, key).agg(*spread("n", 2, (0.5, 0.75, 0.95, 0.99), std=False), F.max("n").alias("max"), F.count(F.lit(1)).alias("entities"), F.sum("n").alias("total"))


def activity_histogram(df: DataFrame, key: str) -> DataFrame:
    """bin, label 'lo-hi', entities; only bins that hold some."""
    h = count_histogram(entity_counts(df, key))
    x = h.crossJoin(F.broadcast(h.agg(F.max("n").alias("largest"))))
    number, width = histogram_bin(F.col("n"), F.col("largest"))
    out = x.select(number.alias("bin"), width.alias("width"), "entities").groupBy("bin", "width").agg(F.sum("entities").alias("entities"))
    return out.select("bin", F.concat(F.col("bin") * F.col("width"), F.lit("-"), F.col("bin") * F.col("width") + F.col("width") - 1).alias("label"), "entities")


def lorenz_curve(df: DataFrame, key: str) -> DataFrame:
    """The curve's corner points, one a distinct count: n, population_share, count_share (6 decimals)."""
    h = count_histogram(entity_counts(df, key)).withColumn("mass", F.col("n") * F.col("entities"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a distinct count
    x = h.select("n", F.sum("entities").over(w).alias("e"), F.sum("mass").over(w).alias("m"))
    total = h.agg(F.sum("entities").alias("te"), F.sum("mass").alias("tm"))
    return x.crossJoin(F.broadcast(total)).select("n", F.round(F.col("e").cast("double") / F.col("te"), 6).alias("population_share"), F.round(F.col("m").cast("double") / F.col("tm"), 6).alias("count_share"))


def cold_start(df: DataFrame, key: str, quantile: float = 0.05) -> DataFrame:
    """The 5th percentile of the counts and the share of entities at or below it."""
    c = entity_counts(df, key)
    cut = c.agg(F.percentile("n", quantile).alias("threshold"))
    return c.crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.round(F.avg((F.col("n") <= F.col("threshold")).cast("double")), 4).alias("cold_ratio"))


def _top_mass(h: DataFrame, k: Column, descending: bool) -> DataFrame:
    """``h`` (n, entities, all) with ``taken``: how many of the first k entities by count have this count."""
    order = F.desc("n") if descending else F.asc("n")
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("before", F.coalesce(F.sum("entities").over(w), F.lit(0))).withColumn("taken", F.greatest(F.least(k - F.col("before"), F.col("entities")), F.lit(0)))


def concentration(df: DataFrame, key: str, percents: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """percent, k = max(1, floor(entities * percent / 100)), and the share of all rows that the k most active entities make."""
    h = count_histogram(entity_counts(df, key))
    total = h.agg(F.sum("entities").alias("te"), F.sum(F.col("n") * F.col("entities")).alias("tm"))
    out = None
    for p in percents:
        k = F.greatest(F.lit(1), F.floor(F.col("te") * p / 100)).cast("bigint")
        x = _top_mass(h.crossJoin(F.broadcast(total)).withColumn("k", k), F.col("k"), True)
        one = x.groupBy("k", "tm").agg(F.sum(F.col("taken") * F.col("n")).alias("m")).select(F.lit(p).alias("percent"), "k", F.round(F.col("m").cast("double") / F.col("tm"), 4).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


def long_tail(df: DataFrame, key: str) -> DataFrame:
    """The share of all rows that the less popular half (rounded down) of the entities makes."""
    h = count_histogram(entity_counts(df, key))
    total = h.agg(F.floor(F.sum("entities") / 2).cast("bigint").alias("k"), F.sum(F.col("n") * F.col("entities")).alias("tm"))
    x = _top_mass(h.crossJoin(F.broadcast(total)), F.col("k"), False)
    return x.groupBy("k", "tm").agg(F.sum(F.col("taken") * F.col("n")).alias("m")).select(F.col("k").alias("tail_entities"), F.round(F.col("m").cast("double") / F.col("tm"), 4).alias("coverage"))


def cross_domain_overlap(df: DataFrame, user: str, domain: str) -> DataFrame:
    """Jaccard of the users of each pair of domains. A user's distinct domains make pairs; domains are few."""
    sets = df.where(F.col(user).isNotNull() & F.col(domain).isNotNull()).groupBy(user).agg(F.array_sort(F.collect_set(domain)).alias("d"))
    size = sets.select(F.explode("d").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    both = sets.select(F.explode("d").alias("a"), "d").select("a", F.explode("d").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    pairs = size.select(F.col("d").alias("a"), F.col("n").alias("na")).join(size.select(F.col("d").alias("b"), F.col("n").alias("nb")), F.expr("a < b"))
    x = pairs.join(both, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return x.select(F.col("a").alias("domain_a"), F.col("b").alias("domain_b"), "common", F.round(F.col("common").cast("double") / (F.col("na") + F.col("nb") - F.col("common")), 4).alias("jaccard"))


# time


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def time_span(df: DataFrame, ts: str) -> DataFrame:
    """first_day, last_day, span_days (whole days between the first and the last time)."""
    x = df.agg(F.min(micros(ts)).alias("lo"), F.max(micros(ts)).alias("hi"), F.min(F.to_date(ts)).alias("first_day"), F.max(F.to_date(ts)).alias("last_day"))
    return x.select(F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), F.floor((F.col("hi") - F.col("lo")) / F.lit(86_400_000_000)).cast("bigint").alias("span_days"))


def monthly_volume(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def daily_peak(df: DataFrame, ts: str) -> DataFrame:
    """active_days, mean rows of an active day (1 decimal), most rows in a day."""
    days = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.agg(F.count(F.lit(1)).alias("active_days"), F.round(F.avg("n"), 1).alias("daily_mean"), F.max("n").alias("daily_peak"))


def retention_curve(df: DataFrame, user: str, ts: str, days: int = 30) -> DataFrame:
    """day, ratio: share of users last seen at least that many days after they were first seen; zero ratios are left out."""
    lives = df.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(user).agg(F.datediff(F.max(F.to_date(ts)), F.min(F.to_date(ts))).alias("life"))
    h = lives.groupBy("life").agg(F.count(F.lit(1)).alias("users"))  # a row a lifetime in days
    total = h.agg(F.sum("users").alias("all_users"))
    grid = h.where("life >= 1").select(F.explode(F.sequence(F.lit(1), F.least("life", F.lit(days)))).alias("day"), "users")
    return grid.groupBy("day").agg(F.sum("users").alias("kept")).crossJoin(F.broadcast(total)).where("all_users > 1").select("day", F.round(F.col("kept").cast("double") / F.col("all_users"), 4).alias("ratio")).where("ratio > 0")


def interaction_gaps(df: DataFrame, user: str, ts: str, tie: str) -> DataFrame:
    """Hours between a user's consecutive rows: mean, p50, p95, max (1 decimal)."""
    before = F.lag("_us").over(Window.partitionBy(user).orderBy("_us", tie))
    x = df.withColumn("_us", micros(ts)).select(((F.col("_us") - before).cast("double") / 3.6e9).alias("h"))
    return x.agg(F.round(F.avg("h"), 1).alias("mean_hours"), F.round(F.percentile("h", 0.5), 1).alias("p50_hours"), F.round(F.percentile("h", 0.95), 1).alias("p95_hours"), F.round(F.max("h"), 1).alias("max_hours"))


# sequences


def user_sequences(df: DataFrame, user: str, order: list[str], item: str) -> DataFrame:
    """user, items: the user's items in order."""
    row = F.struct(*order, F.col(item).alias("_item"))
    return df.groupBy(user).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["_item"]).alias("items"))


def sequence_lengths(df: DataFrame, items: str) -> DataFrame:
    """mean, std, min, max, p50, p95, p99 (2 decimals) of the lengths, and the share of empty ones (4); null counts as empty."""
    x = df.select(F.coalesce(F.size(items), F.lit(0)).alias("n")).select(F.greatest("n", F.lit(0)).alias("n"))
    return x.agg(*spread("n", 2, (0.5, 0.95, 0.99)), F.min("n").alias("min"), F.max("n").alias("max"), F.round(F.avg((F.col("n") == 0).cast("double")), 4).alias("empty_rate"))


def repeat_rate(df: DataFrame, items: str) -> DataFrame:
    """Mean share of repeated items over the sequences that are not empty."""
    x = df.where(F.size(items) > 0).select((1 - F.size(F.array_distinct(items)) / F.size(items)).alias("r"))
    return x.agg(F.round(F.avg("r"), 4).alias("repeat_rate"), F.count(F.lit(1)).alias("sequences"))


def sequence_coverage(df: DataFrame, items: str) -> DataFrame:
    return df.select(F.explode(items).alias("i")).agg(F.countDistinct("i").alias("distinct_items"), F.count(F.lit(1)).alias("total_items"))


# vectors


def vector_norms(df: DataFrame, v: str) -> DataFrame:
    x = df.where(F.col(v).isNotNull()).select(norm(F.col(v)).alias("n"))
    return x.agg(*spread("n", 6, (0.25, 0.5, 0.75, 0.95)), F.round(F.min("n"), 6).alias("min"), F.round(F.max("n"), 6).alias("max"))


def zero_and_duplicate_vectors(df: DataFrame, v: str, places: int = 4) -> DataFrame:
    """vectors, zero ones, their share, and the share that equals another one after rounding (first of each kept)."""
    x = df.where(F.col(v).isNotNull()).select(F.forall(v, lambda x: x == 0).alias("z"), F.transform(v, lambda x: F.round(x.cast("double"), places)).alias("r"))
    # equal vectors shrink to a row before anything is counted
    g = x.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z").cast("bigint")).alias("z"))
    return g.agg(F.sum("n").alias("vectors"), F.sum("z").alias("zero_vectors"), F.count(F.lit(1)).alias("distinct_vectors")).select(
        "vectors", "zero_vectors", F.round(F.col("zero_vectors").cast("double") / F.col("vectors"), 4).alias("zero_ratio"), F.round(1 - F.col("distinct_vectors").cast("double") / F.col("vectors"), 4).alias("duplicate_ratio")
    )


def dimension_moments(df: DataFrame, v: str) -> DataFrame:
    """dim, mean, std (population) of each component."""
    return df.select(F.posexplode(v).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"), F.var_pop(F.col("x").cast("double")).alias("variance"))


def dimension_variance(df: DataFrame, v: str) -> DataFrame:
    m = dimension_moments(df, v)
    return m.agg(F.round(F.avg("variance"), 6).alias("mean_variance"), F.round(F.min("variance"), 6).alias("min_variance"), F.round(F.max("variance"), 6).alias("max_variance"), F.round(F.avg(F.abs("mean")), 6).alias("mean_abs_mean"), F.count(F.lit(1)).alias("dims"))
