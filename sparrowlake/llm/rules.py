"""Quality classifier: a sparse ensemble of rules compiled into Spark columns.

``with_statistics`` describes a whole text by numbers made with built-in functions. ``fit`` grows boosted shallow trees over the statistics of a bounded sample
of labelled rows (``SAMPLE_ROWS``, a parameter), takes each path from a root as a
conjunctive rule, and fits logistic weights with a lasso penalty, which leaves few
rules. ``score`` states the rules as one column expression, so scoring is a projection
inside generated code, without Python.

Nulls: a null text has the statistics of an empty one and gets a score like it. Rows
without a label or id are not learnt from; without any labels the score is 0.5
everywhere, and with one class, or so few rows that no condition leaves five of them on
either side, it is label 1's smoothed share. Repeated labels and documents count each
time as far as the sample reaches; at its bound the order is by the id's hash, the id,
the label and the statistics, so ties are equal rows. Repeated rows score alike; a very
long text is one row. Columns named as an output or a statistic
(``_s_...``) are replaced, all others carried along; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm.common import without

SAMPLE_ROWS = 12_000
STATS = [
    "log_chars", "log_words", "mean_word", "distinct_words", "digits", "capitals", "symbols", "stops", "commas", "lines", "repeated_lines", "longest_word", "odd_words", "short_words", "wide", "runs", "symbol_ends", "top_line",
]
BINS, TREES, DEPTH, RATE = 32, 24, 3, 0.3
ACCEPT_FROM = 0.5


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one double column ``_s_<name>`` for each of STATS; words are what lies between ASCII white space, lines have more than that."""
    df = without(df, [f"_s_{s}" for s in STATS] + ["_t", "_w", "_l"])
    t = F.coalesce(F.col(text), F.lit(""))
    a = df.withColumn("_t", t).withColumn("_w", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda x: x != "")).withColumn("_l", F.filter(F.split("_t", r"\n"), lambda x: F.trim(x) != ""))
    chars, words, lines = F.length("_t").cast("double"), F.size("_w").cast("double"), F.size("_l").cast("double")
    per = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    left = lambda p: F.length(F.regexp_replace("_t", p, "")).cast("double")
    are = lambda f: F.size(F.filter("_w", f)).cast("double")
    values = {
        "log_chars": F.log1p(chars),
        "log_words": F.log1p(words),
        "mean_word": per(F.length(F.array_join("_w", "")).cast("double"), words),
        "distinct_words": per(F.size(F.array_distinct("_w")).cast("double"), words),
        "digits": per(chars - left("[0-9]+"), chars),
        "capitals": per(chars - left(r"\p{Lu}+"), chars),
        "symbols": per(left(r"[\p{L}\p{N}\s.,;:'\"!?()-]+"), chars),
        "stops": per(chars - left("[.!?]+"), words),
        "commas": per(chars - left("[,;:]+"), words),
        "lines": per(lines, words),
        "repeated_lines": per(lines - F.size(F.array_distinct("_l")), lines),
        "longest_word": F.log1p(F.coalesce(F.array_max(F.transform("_w", F.length)), F.lit(0)).cast("double")),
        "odd_words": per(are(lambda w: ~w.rlike(r"\p{L}")), words),
        "short_words": per(are(lambda w: F.length(w) <= 3), words),
        "runs": per(chars - F.length(F.regexp_replace("_t", r"([^\s])\1{2,}", "$1")), chars),
        "symbol_ends": per(are(lambda w: w.rlike(r"[^\p{L}\p{N}.,;:'\"!?()-]$")), words),
        "top_line": F.log1p(F.coalesce(F.array_max(F.transform("_l", F.length)), F.lit(0)).cast("double")),
        "wide": per(F.octet_length("_t") - chars, chars),
    }
    # a generator of one row keeps Catalyst from putting the statistics in place of their names in every rule and filter above
    row = F.inline(F.array(F.struct(*(values[k].cast("double").alias(f"_s_{k}") for k in STATS))))
    return a.select(*(df[f"`{c}`"] for c in df.columns), row)


@dataclass(frozen=True)
class Rules:
    """``rules``: (conditions, weight) with conditions (statistic, below, threshold); the score is the logistic of the intercept and the weights of the rules that hold."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[int, bool, float], ...], float], ...]


def _trees(x: np.ndarray, y: np.ndarray) -> list[tuple[tuple[int, bool, float], ...]]:
    """The paths of boosted trees over binned statistics."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1)  # code <= b: x <= cuts[b]
    at = code + np.arange(m) * BINS
    margin, paths = np.zeros(n), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        nodes = [((), np.arange(n))]
        for level in range(DEPTH):
            split = []
            for path, rows in nodes:
                flat = at[rows].ravel()
                hg = np.bincount(flat, np.repeat(g[rows], m), m * BINS).reshape(m, BINS).cumsum(1)
                hh = np.bincount(flat, np.repeat(h[rows], m), m * BINS).reshape(m, BINS).cumsum(1)
                hn = np.bincount(flat, minlength=m * BINS).reshape(m, BINS).cumsum(1)
                gain = hg**2 / (hh + 1) + (hg[:, -1:] - hg) ** 2 / (hh[:, -1:] - hh + 1)
                gain[(hn < 5) | (hn[:, -1:] - hn < 5)] = -1
                j, b = divmod(int(gain.argmax()), BINS)
                if gain[j, b] <= hg[0, -1] ** 2 / (hh[0, -1] + 1) + 1e-6 or b >= len(cuts[j]):
                    margin[rows] += RATE * hg[0, -1] / (hh[0, -1] + 1)
                    continue
                low = code[rows, j] <= b
                for below, part in ((True, rows[low]), (False, rows[~low])):
                    longer = (*path, (j, below, float(cuts[j][b])))
                    paths.append(longer)
                    split.append((longer, part))
                    if level == DEPTH - 1:
                        margin[part] += RATE * g[part].sum() / (h[part].sum() + 1)
            nodes = split
    return list(dict.fromkeys(map(_merged, paths)))


def _merged(path: tuple) -> tuple:
    """Conditions on one statistic and side merged into the tightest, in a fixed order."""
    best: dict[tuple[int, bool], float] = {}
    for j, below, v in path:
        best[j, below] = v if (j, below) not in best else (min if below else max)(v, best[j, below])
    return tuple((j, below, v) for (j, below), v in sorted(best.items()))


def _holds(x: np.ndarray, conditions: tuple) -> np.ndarray:
    return np.logical_and.reduce([x[:, j] <= v if below else x[:, j] > v for j, below, v in conditions])


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, b: float, steps: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; columns of r are scaled 0/1."""
    n = len(y)
    v = np.ones(r.shape[1]) / max(1, r.shape[1]) ** 0.5
    for _ in range(8):
        v = (r @ v.astype(np.float32)) @ r
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * n / (1.1 * np.linalg.norm(r @ v.astype(np.float32)) ** 2 + n)
    z, zb, t = w, b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(r @ z.astype(np.float32) + zb))) - y
        new = z - rate * (e.astype(np.float32) @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = zb - rate * e.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb, t, w, b = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b), t2, new, nb
    return w, b


def learn(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules from the statistics of labelled rows; the penalty with the least loss on a fifth that is set aside is taken."""
    prior = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(prior / (1 - prior)))
    paths = _trees(x, y) if len(y) and y.min() < y.max() else []
    if not paths:  # no labels, one class, or no statistic with five rows on either side that parts the classes
        return Rules(start if len(y) else 0.0, ())
    r = np.stack([_holds(x, p) for p in paths], 1).astype(np.float32)
    scale = np.maximum(r.std(0), 1e-3)
    r /= scale
    aside = np.arange(len(y)) % 5 == 0
    w, b, best = np.zeros(r.shape[1]), start, None
    for penalty in (0.03, 0.01, 0.003, 0.001):
        w, b = _lasso(r[~aside], y[~aside], penalty, w, b)
        p = np.clip(1 / (1 + np.exp(-(r[aside] @ w + b))), 1e-6, 1 - 1e-6)
        loss = -(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    w, b = _lasso(r, y, best[1], w, b, 200)
    kept = tuple((p, float(v / s)) for p, v, s in zip(paths, w, scale) if abs(v) > 1e-9)
    return Rules(float(b), kept)


def score(rules: Rules) -> Column:
    """The score as a column over the columns ``_s_...``."""
    total = F.lit(rules.intercept)
    for conditions, weight in rules.rules:
        holds = None
        for j, below, v in conditions:
            c = F.col(f"_s_{STATS[j]}")
            one = c <= F.lit(v) if below else c > F.lit(v)
            holds = one if holds is None else holds & one
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Learn from at most ``sample_rows`` of the labelled rows, the first by a hash of the id; ``labels`` holds only rows that may be learnt from."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y")]
    picked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").orderBy(*order).limit(sample_rows)
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")  # sample_rows bounds the broadcast
    rows = with_statistics(found).drop("text").orderBy(*order, *(f"_s_{s}" for s in STATS)).limit(sample_rows).toPandas()
    return learn(rows[[f"_s_{s}" for s in STATS]].to_numpy(float), rows["y"].to_numpy(float))


def classify(df: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (probability of label 1) and ``predicted`` (1 if score >= ACCEPT_FROM)."""
    scored = with_statistics(without(df, ["score", "predicted"]), text).withColumn("score", score(rules))
    return scored.drop(*(f"_s_{s}" for s in STATS)).withColumn("predicted", (F.col("score") >= ACCEPT_FROM).cast("int"))
