"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

``find`` lists a row's candidates: the base kinds ``assign``, ``access`` and ``hex``,
and ``loose``, other long runs that look like a credential. ``judge`` hashes each
candidate's value, counts the distinct owners and repositories that hold it in the
whole corpus, and separates values that many owners carry (``example``: copied from
documentation or templates) from those that stay with few (``live``). Base spans stay
whatever their verdict; a loose candidate becomes a span only if it is live.

Positions are code points, ends exclusive. They come from the lengths of the matches
and of the text between them by a running sum, which needs no Python: an array is cut
into blocks, and blocks into blocks of blocks, so a step copies ``BLOCK`` values at most
and the work is linear in the number of matches.

Nulls: a null text has no candidates; a null owner or repository counts as one value
of its own. Empty texts and empty tables give no spans. Repeated rows are judged
alike (they add no owner). Columns named ``found``, ``spans`` or ``_row`` are
replaced, all others carried along. A very long text is one row; the work of a row is
linear in its length and its number of matches.

Skew: distinct (value, owner, repository) triples are aggregated before the shuffle. On
the way back a value's counts go to the salts that it occurs under, ``SALT`` at most, so a
value that a third of all rows hold is spread and a rare one is not multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm.common import stage, without

#: The base kinds in their order, and their patterns.
KINDS = ["assign", "access", "hex", "loose"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With the least length in the pattern these two find what remains after dropping: a shorter run holds no match that is long enough.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A run that could be a key and has a digit, a capital and a small letter.
LOOSE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[A-Z0-9_-]*[a-z])(?=[a-z0-9_-]*[A-Z])[A-Za-z0-9_-]{20,}"
SALT = 16
#: Values in a block of a running sum, and code points in a block of a text.
BLOCK, BLOCK_CHARS = 64, 4096


def _once(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it: inside a lambda an expression would be computed at each step."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(values: Column, op, levels: int = 3) -> Column:
    """The running value of op (sum, max, min) over an array of numbers without nulls, each place included."""

    def small(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<bigint>"), lambda done, x: F.concat(done, F.array(F.coalesce(op(F.try_element_at(done, F.lit(-1)), x), x))))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, BLOCK))

    def shifted(parts: Column, before: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: op(F.get(before, i - 1), x)))))

    def whole(x: Column) -> Column:
        inner = F.transform(blocks(x), small)
        return _once(inner, lambda parts: _once(running(F.transform(parts, lambda p: F.element_at(p, -1)), op, levels - 1), lambda before: shifted(parts, before)))

    return _once(values.cast("array<bigint>"), lambda x: F.when(F.size(x) <= BLOCK, small(x)).otherwise(whole(x) if levels else small(x)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).otherwise(F.greatest(a, b))


def _least(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).otherwise(F.least(a, b))


def _spans(text: Column, kind: int, pattern: str, value_group: int = 0) -> Column:
    """All matches as structs (start, kind, end, value), from the lengths of the pieces between them."""
    p = F.lit(pattern)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    value = lambda m: F.regexp_extract(m, pattern, value_group) if value_group else m

    def walked(found: Column) -> Column:
        m, b = found["m"], found["b"]
        sizes = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(b, i)))
        row = lambda x, i, ends: F.struct((F.get(ends, i) - F.length(x)).cast("int").alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).cast("int").alias("end"), value(x).alias("value"))
        return _once(running(sizes, _sum), lambda ends: F.transform(m, lambda x, i: row(x, i, ends)))

    found = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))
    return F.when(text.rlike(pattern), _once(found, walked)).otherwise(none)


def _free(base: Column, loose: Column) -> Column:
    """The loose spans that no base span overlaps: none before reaches into them, none after begins within them."""

    def kept(spans: Column) -> Column:
        before = running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), _most)
        after = F.reverse(running(F.transform(F.reverse(spans), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(2147483647)), _least))
        clear = lambda b, a: F.filter(spans, lambda s, i: (s["kind"] == 3) & (F.get(b, i) <= s["start"]) & (F.get(a, i) >= s["end"]))
        return _once(before, lambda b: _once(after, lambda a: clear(b, a)))

    return F.when((F.size(base) > 0) & (F.size(loose) > 0), _once(F.array_sort(F.concat(base, loose)), kept)).otherwise(loose)


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``found``: structs (start, kind, end, hash) sorted by start, then kind; ``kind`` indexes KINDS."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_spans(t, 0, ASSIGN, 2), lambda s: F.length(s["value"]) >= 8)
    base = F.concat(assign, _spans(t, 1, ACCESS), _spans(t, 2, HEX))
    kept = without(df, ["found", "_base", "_loose"]).withColumn("_base", base).withColumn("_loose", _spans(t, 3, LOOSE))
    both = F.array_sort(F.concat("_base", _free(F.col("_base"), F.col("_loose"))))
    hashed = F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.unhex(F.md5(s["value"])).alias("hash")))
    # rows without candidates, most of them, skip the rest
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hash:binary>>")
    return kept.withColumn("found", F.when(F.size("_base") + F.size("_loose") > 0, hashed).otherwise(none)).drop("_base", "_loose")


def judge(df: DataFrame, owner: str, repository: str, wide_owners: int = 3) -> DataFrame:
    """``df`` (with ``found``) plus ``spans``: structs (start, kind, end, owners, repositories, live) of the base candidates and the live loose ones."""
    held, _ = stage(without(df, ["_row", "spans"]).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    some = held.where(F.size("found") > 0)
    each = some.select("_row", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("o"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("r"), F.inline("found"))
    # distinct triples first: a value copied within one owner's repository shrinks to a row before the shuffle
    triples = each.groupBy("hash", "o", "r").agg(F.lit(1).alias("one"))
    by_owner = triples.groupBy("hash", "o").agg(F.count(F.lit(1)).alias("r"))
    freq = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"))
    salted = each.withColumn("salt", F.pmod("_row", F.lit(SALT)).cast("int"))
    wanted = salted.select("hash", "salt").distinct().join(freq, "hash")  # a hash has as many rows as salts it occurs under
    judged = salted.join(wanted, ["hash", "salt"])
    judged = judged.withColumn("live", F.col("owners") < wide_owners).where((F.col("kind") < 3) | F.col("live"))
    span = F.struct("start", "kind", "end", "owners", "repositories", "live")
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,live:boolean>>")
    # rows without candidates pass beside the join, so only the few others are shuffled
    quiet = held.where(F.size("found") == 0).withColumn("spans", none)
    return some.join(spans, "_row", "left").withColumn("spans", F.coalesce("spans", none)).unionByName(quiet).drop("_row", "found")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def redact(df: DataFrame, text: str = "text", spans: str = "spans", live: str = "[SECRET]", example: str = "[EXAMPLE]") -> DataFrame:
    """``df`` with every span of the text replaced; spans that overlap are replaced as one, by the first one's mark."""
    t = F.col(text)

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """The code points from a up to b, out of the blocks that hold them."""
        part = lambda k: F.substring(F.get(blocks, k), (F.greatest(a - k * BLOCK_CHARS, F.lit(0)) + 1).cast("int"), (F.least(b, (k + 1) * BLOCK_CHARS) - F.greatest(a, k * BLOCK_CHARS)).cast("int"))
        return F.when(b > a, F.array_join(F.transform(F.sequence((a / BLOCK_CHARS).cast("int"), ((b - 1) / BLOCK_CHARS).cast("int")), part), "")).otherwise("")

    def cut(blocks: Column) -> Column:
        def joined(ends: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
            fresh = lambda s, i: F.concat(piece(blocks, before(i), s["start"]), F.when(s["live"], live).otherwise(example))
            parts = F.transform(F.col(spans), lambda s, i: F.when(s["start"] >= before(i), fresh(s, i)).otherwise(""))
            return F.concat(F.array_join(parts, ""), piece(blocks, F.element_at(ends, -1), F.length(t)))

        return _once(running(F.transform(F.col(spans), lambda s: s["end"]), _most), joined)

    whole = _once(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0)), cut)
    return df.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(t))
