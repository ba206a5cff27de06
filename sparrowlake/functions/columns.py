"""Column expressions: deterministic hashes, encoders, sequences, vectors, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_word(*parts: Column) -> Column:
    """The first 32 bits of md5 of the parts joined by ':', as BIGINT; other engines compute the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A reproducible number in (0, 1): (word + 0.5) / 2^32."""
    return (md5_word(*parts).cast("double") + 0.5) / F.lit(4294967296.0)


def hash_cross(a: Column, b: Column, buckets: int = 1_000_000) -> Column:
    """md5 of 'a_X_b' as a 128-bit integer modulo ``buckets`` (under 2^31), folded 32 bits at a time."""
    digest = F.md5(F.concat(a.cast("string"), F.lit("_X_"), b.cast("string")))
    out = F.lit(0).cast("bigint")
    for i in range(4):
        out = (out * F.lit(4294967296) + F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")) % F.lit(buckets)
    return out


def embedding_dim(n: Column, rule: str = "google") -> Column:
    """Width of an embedding for n categories by a rule of thumb; 1 for n <= 1."""
    n = n.cast("bigint")
    if rule == "google":
        wide = F.least(F.greatest(F.bround(2 * F.pow(n.cast("double"), F.lit(0.25)), 0), F.lit(1.0)), F.lit(600.0))
    elif rule == "fastai":
        wide = F.greatest(F.lit(1.0), F.least(F.lit(50.0), F.floor(1.6 * F.pow(n.cast("double"), F.lit(0.25))).cast("double"), F.floor(n / 2).cast("double")))
    elif rule == "rule_of_thumb":
        wide = F.least(F.lit(50.0), F.floor(F.sqrt(n.cast("double"))).cast("double"))
    else:
        wide = F.least(F.lit(50), n - 1)
    return F.when(n <= 1, F.lit(1)).otherwise(wide).cast("bigint")


def pad_truncate(items: Column, length: int, side: str = "right", fill: object = 0) -> Column:
    """``right``: keep the head and pad behind; ``left``: keep the tail and pad in front."""
    pad = F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(items), F.lit(0)).cast("int"))
    if side == "right":
        return F.concat(F.slice(items, 1, length), pad)
    kept = F.when(F.size(items) > length, F.slice(items, F.size(items) - length + 1, length)).otherwise(items)
    return F.concat(pad, kept)


def minmax(x: Column, low: Column, high: Column) -> Column:
    return F.when(high - low == 0, F.lit(0.0)).otherwise((x - low) / (high - low))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.greatest(std, F.lit(1e-8))


def log1p_norm(x: Column) -> Column:
    return F.log1p(F.greatest(x.cast("double"), F.lit(0.0)))


def non_negative_int(x: Column) -> Column:
    """A null-tolerant integer: what does not parse, and what is negative, becomes 0."""
    return F.greatest(F.coalesce(x.try_cast("bigint"), F.lit(0)), F.lit(0))


def parse_sequence(text: Column) -> Column:
    """'[1, 2, 3]' as an array; null if it does not parse."""
    return F.from_json(text, "array<bigint>")


def sequence_element(item: Column, fields: list[str] | None = None) -> Column:
    """An element of a sequence as an identifier: a struct's ``item_id`` if it has that field, else its fields by name as text; other elements as they are. ``fields``: the struct's."""
    if fields is None:
        return item
    if "item_id" in fields:
        return item["item_id"]
    return F.to_json(F.struct(*(item[f].alias(f) for f in sorted(fields))))


def sanitize(name: Column) -> Column:
    """Lower case, runs of characters outside [a-z0-9_-] as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "_"), "_+", "_"), "^_|_$", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """v / max(|v|, 1e-10)."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(1e-10)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-10)) * F.greatest(norm(b), F.lit(1e-10)))


def negative_l2(a: Column, b: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def histogram_bin(count: Column, largest: Column) -> tuple[Column, Column]:
    """Bin number and width of an equal-width histogram with 10 bins at most, the last one closed."""
    width = F.greatest(F.lit(1), F.ceil(largest / 10)).cast("bigint")
    bins = F.ceil(largest / width)
    return F.least(F.floor(count / width), bins - 1).cast("bigint"), width


def log_loss(y: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def bpr_loss(positive: Column, negative: Column) -> Column:
    return F.log1p(F.exp(negative - positive))


def focal_loss(y: Column, p: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    own = F.when(y == 1, p).otherwise(1 - p)
    weight = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return -weight * F.pow(1 - own, F.lit(gamma)) * F.log(own)


def bce_with_logits(y: Column, logit: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def top1_loss(positive: Column, negative: Column) -> Column:
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return sigmoid(negative - positive) + sigmoid(negative * negative)


def huber_loss(y: Column, p: Column, delta: float = 1.0) -> Column:
    e = F.abs(y - p)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
