"""Item-based collaborative filtering over (user, item[, rating]) pairs.

Similarities, regressions and co-occurrences add their pairs up by blocks of items (``pairing``), which keeps
the best of an item, a pair's line or count, and never shuffles a row a pair. Items
that are no whole numbers (or lie more than ``pairing.MOST_SPAN`` apart) and ratings that are missing
take a join: co-occurrence is one self-join on the user, halved by item_i < item_j and summed with
map-side combine; the mirror image is added after the aggregation, in the same pass. The
items of a very active user are dealt to blocks of about ``BLOCK`` and joined a pair of
blocks at a time, so no key of the join makes more than BLOCK^2 pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.operators import pairing, unseen

#: About so many items of a user are joined with each other under one key.
BLOCK = 2000


def pairs(log: DataFrame, user: str, item: str, rating: str | None = None) -> DataFrame:
    """Distinct (u, i), with the mean rating r, or 1."""
    return log.where(F.col(user).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(user).alias("u"), F.col(item).alias("i")).agg(F.avg(F.col(rating).cast("double")).alias("r") if rating else F.lit(1.0).alias("r"))


def _co(x: DataFrame, *sums: Column) -> DataFrame:
    """item_i < item_j with sums over the users that have both; ``x`` has u, i, v."""
    blocks = x.groupBy("u").agg(F.expr(f"count(*) DIV {BLOCK} + 1").alias("blocks"))
    dealt = x.join(blocks, "u").withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")))
    # a block meets each block, itself included, under the key (smaller number, larger number)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    side = lambda n: met.select("u", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.col("i").alias(f"item_{n}"), F.col("v").alias(f"v{'ab'[n == 'j']}"), F.col("own").alias(f"own_{n}"))
    once = F.expr("item_i < item_j AND (own_i <> own_j OR p = q)")
    return side("i").join(side("j"), ["u", "p", "q"]).where(once).groupBy("item_i", "item_j").agg(*sums)


def _mirrored(s: DataFrame) -> DataFrame:
    rest = [c for c in s.columns if c not in ("item_i", "item_j")]
    both = F.array(F.struct("item_i", "item_j"), F.struct(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j")))
    return s.select(F.explode(both).alias("e"), *rest).select("e.*", *rest)


def _joined(x: DataFrame) -> DataFrame:
    return _co(x.withColumn("v", F.lit(1)), F.count(F.lit(1)).alias("together"))


def cooccurrence(x: DataFrame) -> DataFrame:
    """item_i, item_j, together (users with both), for item_i < item_j. The users' lists are packed by blocks of items (``pairing.counted``)."""
    lists = pairing.listed(x)
    found = pairing.counted([lists], x.schema["i"].dataType) if lists else None
    if found is None:
        return _joined(x)
    found._lists = [lists]
    return found


def _popularity(x: DataFrame) -> DataFrame:
    return x.groupBy("i").agg(F.count(F.lit(1)).cast("double").alias("d"))


def _normed(co: DataFrame, size: DataFrame) -> DataFrame:
    """v / sqrt(d_i * d_j); ``size`` has i, d."""
    s = co.join(size.select(F.col("i").alias("item_i"), F.col("d").alias("di")), "item_i").join(size.select(F.col("i").alias("item_j"), F.col("d").alias("dj")), "item_j")
    return s.where("di > 0 AND dj > 0").select("item_i", "item_j", (F.col("v") / F.sqrt(F.col("di") * F.col("dj"))).alias("sim"))


def top(sim: DataFrame, k: int) -> DataFrame:
    """The k most similar items of each, ties (to 9 decimals) to the smaller id."""
    r = F.row_number().over(Window.partitionBy("item_i").orderBy(F.round("sim", 9).desc(), "item_j"))
    return sim.withColumn("rank", r).where(F.col("rank") <= k)


def _on_table(similarity: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Gives ``similarity`` its pairs as a written table, and drops the table if the result no longer reads it."""

    @wraps(similarity)
    def run(x: DataFrame, *args: object, **options: object) -> DataFrame:
        table = pairing.kept(x, "rated")
        own = table is not x
        del x  # so that the shuffle files of what wrote the table can go
        found = similarity(table, *args, **options)
        if own and pairing.written(found):
            pairing.drop(table)
        return found

    return run


def _best(x: DataFrame, columns: list[str], sums: pairing.Sums, sim: Callable[[np.ndarray, list], tuple[np.ndarray, np.ndarray]], k: int, least: int = 1, wide: int = 0, normed: bool = False) -> DataFrame | None:
    """item_i, item_j, sim, rank as ``top`` has them; ``sim`` gives a similarity and whether it counts. ``normed``: as ``row_normalized`` has them."""

    def finish(key: np.ndarray, n: np.ndarray, of: list[np.ndarray], span: int) -> list[np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            value, ok = sim(n, of)
        key, value = key[ok], value[ok]
        at, rank = pairing.best(key, value, span, k)
        key, value = key[at], value[at]
        if normed and len(at):
            first = np.flatnonzero(rank == 1)
            most = np.repeat(np.maximum.reduceat(value, first), np.diff(np.append(first, len(rank))))
            value = np.where(most > 0, value / np.where(most > 0, most, 1), value)
        return [key, value, rank.astype(np.int32)]

    return pairing.meet(x, columns, sums, finish, [("sim", T.DoubleType()), ("rank", T.IntegerType())], least=least, wide=wide)


def _scaled(n: np.ndarray, of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A sum by the root of the product of sizes."""
    return of[0] / np.sqrt(of[1]), of[1] > 0


@_on_table
def cosine(x: DataFrame, k: int = 50, normed: bool = False) -> DataFrame:
    """``normed``: by the largest similarity of the item, as ``row_normalized`` of the result; where the pairs are packed no row is shuffled for it."""
    size = _popularity(x)
    found = _best(x.join(size, "i"), ["d"], pairing.Sums(lambda a, b: [a[0] * b[0]], (0,)), lambda n, of: _scaled(n, [n, *of]), k, normed=normed)
    if found is not None:
        return found
    s = top(_mirrored(_normed(_joined(x).withColumn("v", F.col("together").cast("double")), size)), k)
    return row_normalized(s) if normed else s


@_on_table
def iuf(x: DataFrame, k: int = 50) -> DataFrame:
    """Cosine whose co-occurrences weigh 1 / ln(1 + n)^2, n the user's items (two at least)."""
    n = x.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    w, size = x.join(n, "u").withColumn("v", 1 / F.log1p(F.col("n").cast("double"))), _popularity(x)
    found = _best(w.join(size, "i"), ["v", "d"], pairing.Sums(lambda a, b: [a[0] * b[0], a[1] * b[1]], (1,)), _scaled, k)
    return found if found is not None else top(_mirrored(_normed(_co(w, F.sum(F.col("va") * F.col("vb")).alias("v")), size)), k)


@_on_table
def adjusted_cosine(x: DataFrame, k: int = 50) -> DataFrame:
    """Cosine of ratings less the user's mean."""
    c = x.join(x.groupBy("u").agg(F.avg("r").alias("m")), "u").select("u", "i", (F.col("r") - F.col("m")).alias("v"))
    size = c.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("d")).where("d > 1e-12")
    found = _best(c.join(size, "i"), ["v", "d"], pairing.Sums(lambda a, b: [a[0] * b[0], a[1] * b[1]], (1,)), _scaled, k, wide=2)
    return found if found is not None else top(_mirrored(_normed(_co(c, F.sum(F.col("va") * F.col("vb")).alias("v")), size)), k)


@_on_table
def pearson(x: DataFrame, k: int = 50, support: int = 2) -> DataFrame:
    """Correlation over co-raters (``support`` at least) of ratings less the item's mean over all its raters."""
    c = x.join(x.groupBy("i").agg(F.avg("r").alias("m")), "i").select("u", "i", (F.col("r") - F.col("m")).alias("v"))
    # the sums are of few pairs once those of fewer users are out
    found = _best(c, ["v"], pairing.Products(), lambda n, of: (of[0] / np.sqrt(of[1] * of[2]), (of[1] > 1e-12) & (of[2] > 1e-12)), k, least=support, wide=1)
    if found is not None:
        return found
    s = _co(c, F.sum(F.col("va") * F.col("vb")).alias("ab"), F.sum(F.col("va") * F.col("va")).alias("aa"), F.sum(F.col("vb") * F.col("vb")).alias("bb"), F.count(F.lit(1)).alias("n"))
    s = s.where((F.col("n") >= support) & (F.col("aa") > 1e-12) & (F.col("bb") > 1e-12)).select("item_i", "item_j", (F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("sim"))
    return top(_mirrored(s), k)


def row_normalized(sim: DataFrame) -> DataFrame:
    """Similarities by the largest of their row, where that is positive."""
    m = F.max("sim").over(Window.partitionBy("item_i"))
    return sim.withColumn("m", m).withColumn("sim", F.when(F.col("m") > 0, F.col("sim") / F.col("m")).otherwise(F.col("sim"))).drop("m")


def top_unseen(history: DataFrame, sim: DataFrame, k: int = 10, weighted: bool = False) -> DataFrame:
    """u, rank, item_id, score, sim_sum: unseen items by the mean weight of the similar history items, then the sum of similarities, then the id.

    They are added up by blocks of users (``unseen``). Users and items that are no whole numbers, and missing ones, take a
    join: each (user, item) goes to its user with the item's similar ones in one row, in waves of users, each written
    before the next; they are summed up where the user's rows lie.
    """
    own = history if weighted else history.withColumn("r", F.lit(1.0))
    table = pairing.kept(history if pairing.written(history) else own.select("u", "i", "r"), "history")
    found = unseen.top(table if weighted else table.withColumn("r", F.lit(1.0)), sim, k)
    if table is not history:
        pairing.drop(table)
    if found is not None:
        return found
    history = pairing.stage(iter([history.select("u", F.col("i").alias("item_i"), (F.col("r") if weighted else F.lit(1.0)).alias("r"))]), "history")
    listed = sim.where("sim IS NOT NULL").groupBy("item_i").agg(F.collect_list(F.struct("item_j", "sim")).alias("e"))
    near = pairing.stage(iter([listed.select("item_i", F.col("e.item_j").alias("j"), F.col("e.sim").alias("s"))]), "near")
    most, n = near.agg(F.max(F.size("j"))).first()[0] or 0, history.count()
    waves = max(1, -(-n * (most + 1) * 12 // max(pairing.LEAST_WAVE, pairing.WAVE_BYTES * n)))

    def wave(w: int) -> DataFrame:
        own = history.where(F.pmod(F.xxhash64("u"), F.lit(waves)) == w)
        # the item itself comes first, without a similarity: what a user has seen takes no join of its own
        own = own.join(near, "item_i", "left").select("u", "r", F.concat(F.array("item_i"), F.coalesce("j", F.expr("slice(array(item_i), 1, 0)"))).alias("j"), F.concat(F.array(F.lit(None).cast("double")), F.coalesce("s", F.expr("slice(array(0D), 1, 0)"))).alias("s"))
        one = own.repartition("u").select("u", "r", F.explode(F.arrays_zip("j", "s")).alias("e")).select("u", F.col("e.j").alias("item_id"), (F.col("e.s") * F.col("r")).alias("num"), F.abs("e.s").alias("size"), F.col("e.s").isNull().alias("seen"))
        s = one.groupBy("u", "item_id").agg(F.sum("num").alias("num"), F.sum("size").alias("sim_sum"), F.bool_or("seen").alias("seen"))
        fresh = s.where("sim_sum > 0 AND NOT seen")
        x = fresh.select("u", "item_id", F.round(F.col("num") / F.col("sim_sum"), 6).alias("score"), F.round("sim_sum", 6).alias("sim_sum"))
        r = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), F.desc("sim_sum"), "item_id"))
        return x.withColumn("rank", r).where(F.col("rank") <= k)

    return wave(0) if waves == 1 else pairing.stage(map(wave, range(waves)), "unseen")


def merge_cooccurrence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Co-occurrence counts add up when the batches hold different users.

    Two results of ``cooccurrence`` are added up where their users' lists meet, so no pair is shuffled.
    """
    if hasattr(old, "_lists") and hasattr(new, "_lists") and old.schema == new.schema:
        found = pairing.counted(old._lists + new._lists, old.schema["item_i"].dataType)
        if found is not None:
            found._lists = old._lists + new._lists
            return found
    return old.unionByName(new).groupBy("item_i", "item_j").agg(F.sum("together").alias("together"))


def _line(key: np.ndarray, n: np.ndarray, columns: list[np.ndarray], span: int) -> list[np.ndarray]:
    """key, n, slope and intercept where the ratings of i differ."""
    differ = columns[4] < columns[5]
    a, b, aa, ab = (c[differ] for c in columns[:4])
    slope = ab / aa
    return [key[differ], n[differ], slope, b - slope * a]


def regression(x: DataFrame, support: int = 5) -> DataFrame:
    """item_i, item_j, slope, intercept: the rating of j by that of i over their co-raters, where i's ratings differ."""
    s = pairing.meet(x, ["r"], pairing.Lines(), _line, [("n", T.LongType()), ("slope", T.DoubleType()), ("intercept", T.DoubleType())], least=support, halved=True)
    if s is None:
        s = _co(x.withColumn("v", F.col("r")), F.regr_slope("vb", "va").alias("slope"), F.regr_intercept("vb", "va").alias("intercept"), F.count(F.lit(1)).alias("n"))
        s = s.where((F.col("n") >= support) & F.col("slope").isNotNull())
    return s.select("item_i", "item_j", "n", (F.round("slope", 10) + 0.0).alias("slope"), (F.round("intercept", 10) + 0.0).alias("intercept"))


def regression_predict(x: DataFrame, coefficients: DataFrame) -> DataFrame:
    """u, item_id, predicted, support: the mean over a user's items i of intercept + slope * rating, for each unseen item j that has coefficients with one."""
    found = x.select("u", F.col("i").alias("item_i"), "r").join(coefficients.select("item_i", "item_j", "slope", "intercept"), "item_i")
    one = found.select("u", F.col("item_j").alias("item_id"), (F.col("intercept") + F.col("slope") * F.col("r")).alias("v"), F.lit(False).alias("seen"))
    own = x.select("u", F.col("i").alias("item_id"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("seen"))
    s = one.unionByName(own).groupBy("u", "item_id").agg(F.avg("v").alias("v"), F.count("v").alias("support"), F.bool_or("seen").alias("seen"))
    return s.where("NOT seen").select("u", "item_id", F.round("v", 6).alias("predicted"), "support")
