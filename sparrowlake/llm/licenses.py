"""License scan: MinHash bands over overlapping text windows, exact containment; DataFrame functions only.

A template's 5-word shingles lie in a window if at least 80 of 100 of them are among the
window's. Templates are grouped by length; a group whose longest template has u words
uses windows of 2u words that begin every u words, so a passage of a template's length
lies whole inside one. Each window has B MinHash values, each a band by itself: with
J the least similarity that a contained template of the group has to a full window,
B = ln(1e-6) / ln(1 - J) bands meet with probability 1 - 1e-6 at least. Windows that
share a band with a template are candidates, confirmed on their full shingle sets.

Only windows with an anchor (a word of ``ANCHORS`` in them) are sketched. That drops
nothing: more than 20 of 100 shingles of every template hold an anchor (verified when
the templates are prepared), so no window without one can hold 80 of 100.

Notices of fewer than 5 words (``NOTICES``) have no 5-word shingle: their one shingle is
their whole word sequence, looked up among a window's shingles of that length. Texts
are chosen by a pattern that the sequence cannot lack, and the windows are those that
hold a place of the sequence. Where it is part of a template's whole text, as 'MIT
License' is of 'Released under the MIT License.', it is the template's alone.

The templates, notices and anchors are parameters; those of the module are a start.

Words are runs of a-z and 0-9 after lowering A-Z, so punctuation and line ends do not
matter. Nulls and empty texts have no license; texts of fewer than 5 words can only hold
a notice. Repeated rows are reported each. A very long text makes windows in
proportion to its length. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.llm.common import stage

#: License statements and the openings of license texts, as published.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}
#: Notices of fewer than K words.
NOTICES = {
    "All-rights-reserved": "All rights reserved.",
    "MIT-notice": "MIT License",
    "Apache-2.0-notice": "Apache License 2.0",
}
ANCHORS = ("licen", "permission", "permitted", "mpl", "mozilla", "redistribut", "granted", "notice", "copies", "software", "source")
GROUPS = (5, 8, 12, 18, 27, 40, 60, 90)
K, MISS = 5, 1e-6


def plain_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))


def plan(texts: dict[str, str] = TEMPLATES, anchors: tuple[str, ...] = ANCHORS) -> list[tuple[int, int, list[str]]]:
    """(longest template's words, bands, templates) of each length group in use; raises if a template could be found without an anchor."""
    out, groups = [], [*GROUPS]
    while groups[-1] < max(len(plain_words(t)) for t in texts.values()):
        groups.append(groups[-1] * 3 // 2)
    for low, up in zip((0, *groups), groups):
        names = [n for n, t in texts.items() if low < len(plain_words(t)) <= up]
        least = 1.0
        for n in names:
            w = plain_words(texts[n])
            grams = {tuple(w[i : i + K]) for i in range(len(w) - K + 1)}
            held = sum(any(a in x for x in g for a in anchors) for g in grams)
            if not grams or held * 100 <= 20 * len(grams):
                raise ValueError(f"template {n} needs an anchor in more of its shingles")
            need = -(-80 * len(grams) // 100)
            least = min(least, need / (2 * up - K + 1 + len(grams) - need))
        if names:
            out.append((up, math.ceil(math.log(MISS) / math.log(1 - least)), names))
    if any(len(plain_words(t)) < K for t in texts.values()):
        raise ValueError("a template is too short")
    return out


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0))


def _shingles(words: Column) -> Column:
    n = F.size(words)
    none = F.array().cast("array<bigint>")
    return F.when(n >= K, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - K + 1, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, K)))))).otherwise(none)


def _bands(shingles: Column, group: int, bands: int) -> Column:
    """One MinHash value a band, hashed with the band's and the group's number."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.xxhash64(F.lit(group), b, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b)))))


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """name, group, its shingles and bands: rows that the driver states."""
    groups = plan(texts, anchors)
    rows = [F.struct(F.lit(n).alias("license"), F.lit(up).alias("grp"), F.lit(b).alias("b"), F.lit(texts[n]).alias("t")) for up, b, names in groups for n in names]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("template", _shingles(_words(F.col("t"))))
    parts = [t.where(F.col("grp") == up).withColumn("band", F.explode(_bands(F.col("template"), up, b))) for up, b, _ in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("license", "grp", "template", "band")


def notices(df: DataFrame, doc_id: str, text: str, short: dict[str, str] = NOTICES, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """The rows of ``scan`` for short notices, over windows of 2 (K - 1) words that begin every K - 1 words."""
    up, out = K - 1, None
    seqs = {n: plain_words(t) for n, t in short.items()}
    if any(not 0 < len(q) <= up for q in seqs.values()):
        raise ValueError("a notice is too short or too long")
    pattern = "(?i)" + "|".join("[^a-z0-9]+".join(q) for q in seqs.values())
    some = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").rlike(pattern))
    held, _ = stage(some.select("doc_id", _words(F.col("t")).alias("w")).where(F.size("w") > 0), "notice-words")
    last = F.greatest(F.ceil(F.size("w") / up) - 2, F.lit(0))

    def at(i: Column, q: list[str]) -> Column:
        """Whether the words from place i on (from 0) are q."""
        return (i >= 0) & (F.slice("w", F.greatest(i + 1, F.lit(1)), F.lit(len(q))) == F.array(*map(F.lit, q)))

    for name, q in seqs.items():
        full = [(i, t) for t in map(plain_words, texts.values()) for i in range(len(t)) if t[i : i + len(q)] == q]

        def own(x: Column, i: Column, q: list[str] = q, full: list = full) -> Column:
            ok = (x == q[0]) & at(i, q)
            for before, t in full:
                ok = ok & ~at(i - before, t)
            return ok

        places = F.filter(F.transform("w", lambda x, i: F.when(own(x, i), i)), lambda i: i.isNotNull())
        near = F.flatten(F.transform("places", lambda p: F.filter(F.array(F.floor(p / up) - 1, F.floor(p / up)), lambda i: (i >= 0) & (i <= last) & (p + len(q) <= i * up + 2 * up))))
        found = held.select("doc_id", "w", places.alias("places")).where(F.size("places") > 0).select("doc_id", F.array_distinct(near).alias("n"))
        rows = found.select("doc_id", F.lit(name).alias("license"), F.size("n").cast("long").alias("windows"), F.lit(1.0).alias("containment"), (F.array_min("n") * up + 1).cast("int").alias("start_word"))
        out = rows if out is None else out.unionByName(rows)
    return out


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: dict[str, str] = TEMPLATES, short: dict[str, str] = NOTICES, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """doc_id, license, windows (how many hold it), containment (the most, 0 to 1), start_word (of the first such window), for each row's licenses."""
    spark = df.sparkSession
    anchor = "|".join(map(re.escape, anchors))
    some = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").rlike(f"(?i){anchor}"))
    listed = some.select("doc_id", F.monotonically_increasing_id().alias("row"), _words(F.col("t")).alias("w"))
    # the places of the anchors, from 0: only windows around them are cut
    places = F.filter(F.transform("w", lambda x, i: F.when(x.rlike(anchor), i)), lambda i: i.isNotNull())
    held, _ = stage(listed.where(F.size("w") >= K).withColumn("places", places).where(F.size("places") > 0), "license-words")
    windows = None
    for up, bands, _ in plan(texts, anchors):
        last = F.greatest(F.ceil(F.size("w") / up) - 2, F.lit(0))
        near = F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(F.floor(p / up) - 1, F.floor(p / up)))))
        w = held.select("doc_id", "row", "w", F.explode(F.filter(near, lambda i: (i >= 0) & (i <= last))).alias("i"))
        w = w.select("doc_id", "row", (F.col("i") * up + 1).cast("int").alias("start_word"), F.slice("w", (F.col("i") * up + 1).cast("int"), F.lit(2 * up)).alias("part"))
        w = w.withColumn("window", _shingles(F.col("part")))
        w = w.where(F.size("window") > 0).select("doc_id", "row", F.lit(up).alias("grp"), "start_word", "window", F.explode(_bands(F.col("window"), up, bands)).alias("band"))
        windows = w if windows is None else windows.unionByName(w)
    # a few dozen bands a template that the caller states
    hits = windows.join(F.broadcast(templates(spark, texts, anchors)), ["grp", "band"]).dropDuplicates(["row", "grp", "start_word", "license"])
    common = F.size(F.array_intersect("window", "template"))
    sure = hits.where(100 * common >= 80 * F.size("template")).select("doc_id", "row", "license", "start_word", (common / F.size("template")).alias("share"))
    found = sure.groupBy("row", "doc_id", "license").agg(F.count(F.lit(1)).alias("windows"), F.max("share").alias("containment"), F.min("start_word").cast("int").alias("start_word")).drop("row")
    return found.unionByName(notices(df, doc_id, text, short, texts)) if short else found
