"""Splits and sequence samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowlake.functions.columns import md5_word, pad_truncate
from sparrowlake.operators.ordered import ID_STEPS, hash_bucket, number_bucket, ranked, running


def _named(place: Column, n: Column, train: float, val: float) -> Column:
    a, b = F.floor(n * train), F.floor(n * train) + F.floor(n * val)
    return F.when(place <= a, "train").when(place <= b, "val").otherwise("test")


def temporal(df: DataFrame, ts: str, tie: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """``df`` with ``split``: the first floor(0.8 n) rows by time are train, the next floor(0.1 n) val. Days are the buckets of the order."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    r = ranked(df, F.coalesce(F.to_date(ts), F.to_date(F.lit("0001-01-01"))), [F.col(ts), F.col(tie)], "_r")
    return r.crossJoin(F.broadcast(n)).withColumn("split", _named(F.col("_r"), F.col("_n"), train, val)).drop("_r", "_n")


def random(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split`` in hash order, the same bounds."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    x = df.withColumn("_h", md5_word(F.lit(seed), F.col(key)))
    r = ranked(x, hash_bucket(F.col("_h")), [F.col("_h"), F.col(key)], "_r")
    return r.crossJoin(F.broadcast(n)).withColumn("split", _named(F.col("_r"), F.col("_n"), train, val)).drop("_r", "_n", "_h")


def per_user(df: DataFrame, user: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the bounds hold for each user's rows in hash order."""
    x = df.withColumn("_h", md5_word(F.lit(seed), F.col(key)))
    r = F.row_number().over(Window.partitionBy(user).orderBy("_h", key))
    n = F.count(F.lit(1)).over(Window.partitionBy(user))
    return x.withColumn("_r", r).withColumn("_n", n).withColumn("split", _named(F.col("_r"), F.col("_n"), train, val)).drop("_r", "_n", "_h")


def cumulative(users: DataFrame, user: str, positions: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """user, positions, split: users in id order are train while the running sum of positions is within floor(0.8 total), then val."""
    total = users.agg(F.sum(positions).alias("_t"))
    x = running(users.select(user, positions), number_bucket(F.col(user), ID_STEPS), [F.col(user)], [positions])
    cum, t = F.col(f"cum_{positions}"), F.col("_t")
    a, b = F.floor(t * train), F.floor(t * train) + F.floor(t * val)
    return x.crossJoin(F.broadcast(total)).select(user, positions, F.when(cum <= a, "train").when(cum <= b, "val").otherwise("test").alias("split"))


def next_item_samples(sequences: DataFrame, user: str, items: str, maxlen: int = 20, keep: str = "earliest") -> DataFrame:
    """user, pos, input, labels: for each position 1..L-1 the items before it and, shifted by one, the items to predict.

    ``keep="earliest"`` keeps the first ``maxlen`` items of a longer prefix, ``"latest"`` the last.
    """
    x = sequences.where(F.size(items) >= 2).select(user, items, F.explode(F.sequence(F.lit(1), F.size(items) - 1)).alias("pos"))
    start = F.lit(1) if keep == "earliest" else F.greatest(F.col("pos") - maxlen + 1, F.lit(1))
    size = F.least(F.col("pos"), F.lit(maxlen))
    return x.select(user, "pos", F.slice(items, start, size).alias("input"), F.slice(items, start + 1, size).alias("labels"))


def flat_pairs(sequences: DataFrame, user: str, items: str) -> DataFrame:
    return sequences.select(user, F.explode(items).alias("item_id"))


def min_length(sequences: DataFrame, items: str, n: int) -> DataFrame:
    return sequences.where(F.size(items) >= n)


def min_action(sequences: DataFrame, seq: str, action: str, least: int, n: int) -> DataFrame:
    """Keep events of at least this action, then sequences of at least n events."""
    return sequences.withColumn(seq, F.filter(seq, lambda e: e[action] >= least)).where(F.size(seq) >= n)


def dense_ids(df: DataFrame, c: str) -> DataFrame:
    """id, dense_id: the distinct non-zero ids in order, numbered from 1; 0 stays for padding and unknown ids."""
    ids = df.where(F.col(c).isNotNull() & (F.col(c) != 0)).select(F.col(c).alias("id")).distinct()
    return ranked(ids, number_bucket(F.col("id"), ID_STEPS), [F.col("id")], "dense_id")


def padded(sequences: DataFrame, user: str, items: str, length: int) -> DataFrame:
    """user, head (right-padded) and tail (left-padded) of the same length."""
    return sequences.select(user, pad_truncate(F.col(items), length).alias("head"), pad_truncate(F.col(items), length, "left").alias("tail"))


def tensor_sequences(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``df`` with each list column cut or padded with 0 to one length: the longest list of these columns, ``most`` at most."""
    longest = df.agg(F.least(F.greatest(*(F.max(F.greatest(F.size(c), F.lit(0))) for c in [*columns, columns[0]])), F.lit(most)).alias("_length"))
    cut = lambda c: F.slice(F.concat(F.coalesce(F.col(c), F.array().cast("array<bigint>")).cast("array<bigint>"), F.array_repeat(F.lit(0).cast("bigint"), F.col("_length"))), F.lit(1), F.col("_length"))
    out = df.crossJoin(F.broadcast(longest))  # one row
    return out.withColumns({c: cut(c) for c in columns}).drop("_length")


def flat_features(df: DataFrame, prefix: str, length: int, name: str) -> DataFrame:
    """``df`` with ``name``: the columns <prefix>_int_..., <prefix>_dense_... and <prefix>_string_... in the table's order as one list of doubles, cut or padded with 0."""
    parts = []
    for c, kind in df.dtypes:
        x, listed = F.col(f"`{c}`"), kind.startswith("array")
        if c.startswith(f"{prefix}_int_"):
            parts.append(F.array(F.coalesce(x.try_cast("bigint"), F.lit(0)).cast("double")))
        elif c.startswith(f"{prefix}_dense_") and listed:
            parts.append(F.transform(F.coalesce(x, F.array().cast(kind)), lambda v: F.coalesce(v.cast("double"), F.lit(0.0))))
        elif c.startswith(f"{prefix}_dense_"):
            parts.append(F.when(x.isNull(), F.array().cast("array<double>")).otherwise(F.array(x.cast("double"))))
        elif c.startswith(f"{prefix}_string_"):
            parsed = x if listed else F.from_json(x, "array<bigint>")
            parts.append(F.transform(F.coalesce(parsed, F.array().cast("array<bigint>")), lambda v: F.coalesce(v.try_cast("bigint"), F.lit(0)).cast("double")))
    whole = F.concat(*parts, F.array_repeat(F.lit(0.0), length))
    return df.withColumn(name, F.slice(whole, 1, length))
