"""Near-duplicate classes: fast similarity sketches, banding, exact verification.

A document's set is its distinct word shingles. Documents with equal sets form a copy
group, which one row each leaves right after the first shuffle. The representatives
are sketched by rounds of hashed bin placement: in round i < T each element falls into
one random bin, in round T + j every element falls into bin j, and a bin keeps the
smallest value of the first round that reaches it. All bins are filled after 2T rounds
at the latest, usually after T ln T / |set|, and the coordinates behave as T nearly
independent MinHash values with concentration bounds.

Banding: B bands of R coordinates. Two sets of similarity s share a band with
probability 1 - (1 - s^R)^B: for B = 48, R = 6 a pair at 0.8 is missed with
probability 5e-7. Candidates are confirmed on the full shingle sets.

No bucket emits all its pairs. First every member of a bucket is paired with the
bucket's smallest member; confirmed links merge a group of near copies at once. Members
in other classes than that are paired with the smallest of them, which merges a group
whose bucket has a stranger as its smallest member. Members that are still in different
classes are then held against each other by an exact prefix filter over their shingles,
rare ones first, so links that pass through no such member are found as well. Where the
first common shingle stands in two sets bounds the sizes that can go together; the
sizes are part of the join's key, so documents that have only a widespread passage in
common, however many they are, make no pairs.
Classes come from alternating large-star and small-star steps over tables in the
shared folder; only row counts and checksums reach the driver.

Nulls: a null or empty text, or one without words, has the empty set and is linked
with nothing. A row without doc_id takes no part; its component_id is null and it is
kept. Rows that share a doc_id are one document: their links are shared, and they have
one class. Repeated rows are copies. Other columns are ignored here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowlake.llm.common import U64, Memo, drop, hashed_words, mix64, shingles, slices, stage

EMPTY = U64(0xFFFFFFFFFFFFFFFF)
BANDS, ROWS = 48, 6
#: Up to so many ids a list of documents is broadcast (16 MB of longs at most); beyond, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000
EDGES_PER_FILE = 1_000_000
#: Size classes have a ratio of exp(1 / SIZE_CLASSES).
SIZE_CLASSES = 50


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of the (non-empty, distinct) sets: an array of len(sets) rows of t coordinates."""
    n = len(sets)
    out = np.full(n * t, EMPTY, U64)
    flat = np.concatenate(sets) if n else np.zeros(0, U64)
    row = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    for i in range(2 * t):
        x = mix64(flat ^ mix64(np.array([i + 1], U64) * U64(0x9E3779B97F4A7C15)))
        where = row * t + ((x >> U64(33)) % U64(t)).astype(np.int64) if i < t else row * t + (i - t)
        free = out[where] == EMPTY  # a bin that an earlier round has filled holds a smaller value
        np.minimum.at(out, where[free], (U64(i) << U64(48)) | (mix64(x[free]) >> U64(16)))
        todo = (out.reshape(n, t) == EMPTY).any(axis=1)
        if not todo.any():
            break
        left = todo[row]
        flat, row = flat[left], row[left]
    return out.reshape(n, t)


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is hashed in."""
    parts = coordinates.reshape(len(coordinates), bands, rows)
    key = np.tile(mix64(np.arange(1, bands + 1, dtype=U64)), (len(coordinates), 1))
    for j in range(rows):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def shingle_sets(texts: pa.Array, k: int, memo: Memo) -> list[np.ndarray]:
    hashes, size = hashed_words(texts, memo)
    return [np.unique(shingles(h, k)) for h in np.split(hashes, np.cumsum(size)[:-1])] if len(size) else []


def sketched(df: DataFrame, doc_id: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), the set's 128-bit fingerprint as (hi, lo), and its band keys."""

    def run(batches):
        memo = Memo()
        for b in (x for batch in batches for x in slices(batch, 1)):
            sets = shingle_sets(b.column(1), k, memo)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            pair = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            keys = np.zeros((len(sets), bands), U64)
            some = [i for i, s in enumerate(sets) if len(s)]
            begin = 0
            while begin < len(some):  # so many documents at a time that bins and elements stay small
                end, size = begin, 0
                while end < len(some) and (end == begin or (size < 200_000 and end - begin < 2000)):
                    size += len(sets[some[end]])
                    end += 1
                part = some[begin:end]
                keys[part] = band_keys(sketch([sets[i] for i in part], bands * rows), bands, rows)
                begin = end
            flat = pa.array(keys.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), lists], names=["doc_id", "n", "hi", "lo", "bands"])

    rows_in = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, n long, hi long, lo long, bands array<long>")


def sets_of(df: DataFrame, doc_id: str, text: str, k: int, ids: DataFrame) -> DataFrame:
    """doc_id and the sorted shingle hashes of the documents listed in ``ids`` (column doc_id)."""

    def run(batches):
        memo = Memo()
        for b in (x for batch in batches for x in slices(batch, 1)):
            sets = [s.view(np.int64) for s in shingle_sets(b.column(1), k, memo)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id", "left_semi")
    return rows.mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have den * intersection >= num * union."""
    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = x.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(den * common >= num * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, n, component, shingle, most): the rarest shingles of each set, so many that two sets of enough similarity share one of them.

    In one total order (rare first) two sets x, y with den * |x & y| >= num * |x | y| have
    a shingle in common among the first |x| - ceil(num |x| / den) + 1 of x and the same of y.
    What many documents share comes late in the order, so sets that have mainly such
    shingles in common do not meet. ``most`` is the largest set that can go with this one if
    that is their first common shingle: what stands from there on in the order, r shingles,
    has to be num / (num + den) of both sizes' sum. Shingles of one component only are left
    out at the end. Repeated rows count once: they would take the places of other shingles.
    """
    # the set's size and hash are computed under the generator: above it they would be computed for each shingle
    own = sets.select("doc_id", "component", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("set"), "shingles")
    each = own.select("doc_id", "component", "n", "set", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), (F.min("component") < F.max("component")).alias("shared"))
    order = Window.partitionBy("doc_id", "component", "set").orderBy("df", "shingle")
    place, again = F.dense_rank().over(order), F.lag("shingle").over(order).eqNullSafe(F.col("shingle"))
    keep = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    most = F.expr(f"({num} + {den}) * (n - place + 1) DIV {num} - n")
    return each.join(often, "shingle").withColumns({"place": place, "again": again}).where((F.col("place") <= keep) & ~F.col("again") & F.col("shared")).select("doc_id", "n", "component", "shingle", most.alias("most"))


def crossing(sets: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (a, b) of documents in different components that can be similar enough (sets: doc_id, component, shingles).

    The larger set of a pair (b) looks for smaller ones (a) at each shingle of its prefix, by
    size class (steps of 2 %), from num / den of its own size up to the bound ``most``. A
    set waits there only if its own bound lets it go with one of its size or more: else
    it could be no pair's smaller set.
    """
    p, _ = stage(prefixes(sets, num, den), "prefixes")
    size_class = lambda n: F.floor(F.log(F.col(n).cast("double")) * SIZE_CLASSES)
    looks = p.withColumns({"low": F.expr(f"({num} * n + {den} - 1) DIV {den}"), "high": F.least("n", "most")}).where("low <= high")
    looks = looks.select("shingle", F.col("component").alias("cb"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.explode(F.sequence(size_class("low"), size_class("high"))).alias("size_class"))
    waits = p.where("most >= n").select("shingle", F.col("component").alias("ca"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), size_class("n").alias("size_class"))
    fits = F.expr(f"ca <> cb AND na <= nb AND na <= mb AND nb <= ma AND {den} * na >= {num} * nb")
    return waits.join(looks, ["shingle", "size_class"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for each node of the edges (a, b), by large-star and small-star steps."""
    spark = edges.sparkSession
    now, path = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = state(now)
    while True:
        files = 1 + seen[0] // EDGES_PER_FILE  # a step makes as many edges as it reads at most: few edges take few tasks
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        held, large_path = stage(large.distinct().coalesce(files), "large-star")
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = held.groupBy("a").agg(F.min("b").alias("m"))
        small = held.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after, next_path = stage(small.where("a <> b").distinct().coalesce(files), "small-star")
        drop(spark, path, large_path)
        before, seen = seen, state(after)
        now, path = after, next_path
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    spark = df.sparkSession
    docs, _ = stage(sketched(df, doc_id, text, k, bands, rows), "sketches")
    linked = docs.where("n > 0 AND doc_id IS NOT NULL")
    # copies have equal band keys, so any of them speaks for the group
    groups, _ = stage(linked.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "groups")
    members, members_path = stage(_shared(groups), "buckets")

    size_ok = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    hub_pairs = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb"))
    first, first_path = stage(hub_pairs.where(size_ok).select("a", "b").distinct(), "hub-pairs")
    sets, sets_path = stage(sets_of(df, doc_id, text, k, first.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "sets")
    links, links_path = stage(confirmed(first, sets, num, den), "links")
    # rows of one document that differ in their sets tie their groups together
    ids = linked.select("doc_id", "hi", "lo").join(groups.select("hi", "lo", "rep"), ["hi", "lo"])
    split = ids.groupBy("doc_id").agg(F.collect_set("rep").alias("reps"), F.min("rep").alias("a")).where(F.size("reps") > 1).select("a", F.explode("reps").alias("b"))
    links = links.unionByName(split).where("a <> b")
    labels, labels_path = stage(components(links), "labels")

    # what is left: members of one bucket in different classes, none of them its hub
    class_of = lambda x, c: x.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class")), c, "left").withColumn(f"{c}_class", F.coalesce(f"{c}_class", c))
    others = class_of(class_of(members.where("rep <> hub"), "rep"), "hub")
    mixed = F.expr("min(rep_class) < max(rep_class)")
    seconds = others.groupBy("key").agg(mixed.alias("mixed"), F.min(F.when(F.col("rep_class") != F.col("hub_class"), F.struct("rep", "n", "rep_class"))).alias("second")).where("mixed").select("key", "second")
    rest, rest_path = stage(others.join(seconds, "key").select("key", "n", "rep", "rep_class", "hub_class", "second"), "open")
    rest_sets, rest_sets_path = stage(sets_of(df, doc_id, text, k, rest.select(F.col("rep").alias("doc_id")).distinct()), "open-sets")
    apart = rest.where("rep_class <> hub_class AND rep_class <> second.rep_class").select(F.col("second.rep").alias("a"), F.col("rep").alias("b"), F.col("second.n").alias("na"), F.col("n").alias("nb"))
    second, second_path = stage(apart.where(size_ok).select("a", "b").distinct(), "second-pairs")
    if not second.isEmpty():
        more, _ = stage(confirmed(second, rest_sets, num, den), "second-links")
        links = links.unionByName(more)
        labels, _ = stage(components(links), "labels")
    # members of one bucket that are in different classes even so
    named = class_of(rest.select("key", "rep"), "rep")
    mixed = named.groupBy("key").agg(mixed.alias("mixed")).where("mixed").select("key")
    open_ = named.join(mixed, "key", "left_semi").select(F.col("rep").alias("doc_id"), F.col("rep_class").alias("component")).distinct()
    third, third_path = stage(crossing(rest_sets.join(open_, "doc_id"), num, den).join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"), "cross-pairs")
    if not third.isEmpty():
        more, _ = stage(confirmed(third, rest_sets, num, den), "more-links")
        labels, _ = stage(components(links.unionByName(more)), "labels")
    named = ids.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    own = named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = docs.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    drop(spark, members_path, first_path, sets_path, links_path, rest_path, rest_sets_path, second_path, third_path)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _shared(groups: DataFrame) -> DataFrame:
    """The members of all buckets that hold more than one group: key, rep, n, hub (the smallest member), hub_n."""
    each = groups.select("rep", "n", F.explode("bands").alias("key"))
    hubs = each.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"))
    return each.join(hubs, "key")
