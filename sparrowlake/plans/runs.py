"""Orchestrated entry points: profile a dataset, run an experiment, preprocess and encode, expand a benchmark.

These are the only places that bring rows to the driver, and only aggregated ones.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.operators import distribution, encoders, itemcf, missing, overview, pairing, profiles, ranking, sampling, sparsity, splits
from sparrowlake.sources import tables

#: Other names of the metrics.
ALIASES = {"auc": "roc_auc", "pr_auc": "average_precision", "ap": "average_precision", "logloss": "log_loss", "acc": "accuracy", "hr": "hit", "hit_rate": "hit", "prec": "precision", "rec": "recall"}


def metric_name(name: str) -> str:
    """The registered name of a metric; a cut-off as in ``hr@10`` is kept."""
    base, at, k = name.strip().lower().partition("@")
    return ALIASES.get(base, base) + at + k


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]


def run_id(experiment: str, dataset: str, model: str, seed: int, config: dict) -> str:
    clean = lambda x: re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_-]", "_", x).lower()).strip("_")
    return f"{clean(experiment)}__{clean(dataset)}__{clean(model)}__seed{seed}__{config_hash(config)}"


#: The charts of a profile, and the result table that each shows.
CHARTS = {
    "column_layout": "overview", "label_distribution": "label", "null_rates": "missing", "cardinality": "cardinality", "cardinality_bins": "cardinality_bins", "coverage_heatmap": "missing",
    "co_missing": "co_missing", "null_rate_by_label": "null_rate_by_label", "label_null_diff": "label_gap", "dense_distributions": "dense", "sequence_lengths": "sequences", "seq_length_summary": "sequences",
    "seq_repeat_rate": "repeats", "feature_auc": "feature_auc", "user_activity": "user_activity", "cross_domain_overlap": "domain_overlap", "vector_norms": "vector_norms", "vector_dim_variance": "vector_variance",
    "sparsity_gauge": "sparsity", "item_lorenz_curve": "lorenz", "monthly_volume": "monthly", "retention_curve": "retention", "rating_distribution": "rating", "user_rating_bias": "user_bias",
    "user_activity_histogram": "user_histogram", "item_popularity_histogram": "item_histogram",
}


def _named(frames: dict[str, DataFrame], key: str) -> DataFrame | None:
    """Results of several columns as one table, the column's name first."""
    out = None
    for name, df in frames.items():
        df = df.select(F.lit(name).alias(key), "*")
        out = df if out is None else out.unionByName(df)
    return out


def profile(df: DataFrame, sample_rows: int | None = None, key: str | None = None, label: str = "label_type", user: str = "user_id", item: str = "item_id", dense: str = "_dense_", domain: str = "domain_") -> dict[str, DataFrame]:
    """Every analysis that a dataset's columns allow, by name; a sample is drawn first if asked for (hybrid with a label and items, else uniform).

    Lazy but for the kinds that the overview looks up. ``dense`` marks dense feature columns,
    list columns that begin with ``domain`` are the sequences of a domain.
    """
    has = set(df.columns)
    if sample_rows is not None and key is not None:
        df = sampling.hybrid(df, label, item, key, sample_rows).drop("origin") if {label, item} <= has else sampling.uniform_sample(df, key, sample_rows)
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    vectors = [c for c in lists if isinstance(df.schema[c].dataType.elementType, (T.FloatType, T.DoubleType))]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (user, item, label, key)]
    features = [c for c in numbers if "_feats_" in c or dense in c] or numbers
    out = {"overview": overview.overview(df), "missing": missing.null_rates(df), "overall_missing": missing.overall(df), "co_missing": missing.co_missing(df), "cardinality": distribution.cardinality(df, df.columns), "cardinality_bins": distribution.cardinality_bins(df, df.columns)}
    if dense_columns := [c for c in numbers if dense in c or isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]:
        out["dense"] = distribution.dense_stats(df, dense_columns)
    if plain:
        out["embedding_keys"] = missing.suspected_embeddings(df, plain)
    if label in has:
        out |= {"label": distribution.shares(df, label), "null_rate_by_label": missing.null_rate_by_label(df, label), "label_gap": missing.label_gap(df, label)}
        if features and df.where(F.col(label).isNotNull() & ~F.col(label).cast("string").isin("0", "1")).isEmpty():
            out["feature_auc"] = distribution.feature_auc(df, label, features)
    if sequences := [c for c in lists if c.startswith(domain)] or [c for c in lists if c not in vectors]:
        out |= {n: _named({c: f(df, c) for c in sequences}, "sequence") for n, f in (("sequences", profiles.sequence_lengths), ("repeats", profiles.repeat_rate), ("sequence_coverage", profiles.sequence_coverage))}
    if vectors:
        out |= {n: _named({c: f(df, c) for c in vectors}, "vector") for n, f in (("vector_norms", profiles.vector_norms), ("vector_zeros", profiles.zero_and_duplicate_vectors), ("vector_variance", profiles.dimension_variance))}
    if {user, item} <= has:
        out |= {"sparsity": sparsity.matrix_profile(df, user, item), "lorenz": profiles.lorenz_curve(df, item), "concentration": profiles.concentration(df, user), "long_tail": profiles.long_tail(df, item)}
        for name, c in (("user", user), ("item", item)):
            out |= {f"{name}_cold_start": profiles.cold_start(df, c), f"{name}_histogram": profiles.activity_histogram(df, c), "user_activity" if name == "user" else "item_popularity": profiles.activity_stats(df, c)}
    if user in has and len(domains := [c for c in lists if c.startswith(domain)]) > 1:
        present = F.explode(F.filter(F.array(*(F.when(F.size(c) > 0, F.lit(c)) for c in domains)), lambda x: x.isNotNull()))
        out["domain_overlap"] = profiles.cross_domain_overlap(df.select(user, present.alias("domain")), user, "domain")
    if rating := overview.detect(df.columns, overview.RATINGS):
        out["rating"] = distribution.shares(df, rating)
        for name, c in (("user", user), ("item", item)):
            if c in has:
                out |= {f"{name}_ratings": profiles.mean_rating_stats(df, c, rating), f"{name}_bias": profiles.bias(df, c, rating), f"{name}_bias_low": profiles.bias(df, c, rating, descending=False)}
    if time := overview.detect(df.columns, overview.TIMES):
        out |= {"time_span": profiles.time_span(df, time), "monthly": profiles.monthly_volume(df, time), "daily": profiles.daily_peak(df, time)}
        if user in has:
            out["retention"] = profiles.retention_curve(df, user, time)
            if tie := key or (item if item in has else None):
                out["gaps"] = profiles.interaction_gaps(df, user, time, tie)
    return out


def profile_report(df: DataFrame, title: str, **options: object) -> tuple[str, dict[str, str]]:
    """A Markdown report, and one JSON document for each chart of CHARTS whose analysis the columns allow and that is not empty."""
    frames = profile(df, **options)
    return tables.markdown(title, frames), tables.charts({c: frames[t] for c, t in CHARTS.items() if t in frames})


def fingerprint(spark: SparkSession, path: str, config: dict, sample_bytes: int = 4096) -> str:
    """md5 over a file's path, size, whole second of change, the md5 of its first bytes (16 digits) and that of the configuration; on any file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(at)
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, sample_bytes).alias("c")).first() if not status.isDirectory() else None
    md5 = lambda b: hashlib.md5(b).hexdigest()
    where = re.sub("^file:/*", "/", status.getPath().toString())
    parts = [where, str(status.getLen()), str(status.getModificationTime() // 1000), md5(bytes(head.c))[:16] if head else "", md5(json.dumps(config, sort_keys=True, default=str).encode())]
    return md5("|".join(parts).encode())


#: The columns of a predictions table by the kind of task: those that name a row, and those that are kept if they are there.
PREDICTIONS = {"pointwise": (["sample_id"], ["y_pred", "group_id"]), "ranking": (["group_id"], ["candidate_id", "num_candidates"]), "multitask": (["task_name"], ["sample_id", "y_mask"])}


def write_predictions(df: DataFrame, path: str, kind: str = "pointwise", split: str = "test") -> None:
    """Predictions as Parquet: what names a row (see PREDICTIONS), y_score, y_true, split, and the optional columns; a row a sample, a candidate of a group, or a sample of a task."""
    own, more = PREDICTIONS[kind]
    out = df.withColumn("split", F.lit(split)) if "split" not in df.columns else df
    if kind == "multitask" and "y_mask" not in df.columns:
        out = out.withColumn("y_mask", F.lit(True))
    tables.materialize(out.select(*own, "y_score", "y_true", "split", *(c for c in more if c in out.columns)), f"{path}/predictions.parquet", mode="overwrite")


def experiment(log: DataFrame, ts: str, row: str, similarity: Callable[[DataFrame, int], DataFrame] = itemcf.cosine, neighbours: int = 20, k: int = 10) -> DataFrame:
    """Split by time, fit, take the best unseen items, evaluate: metric, value, std, group_count.

    The log, its split and the pairs to fit on are written once, and each goes when nothing reads it any more.
    """
    log = pairing.stage(iter([log.select("user_id", "item_id", F.col(ts).alias("ts"), F.col(row).alias("row"))]), "log")
    pairing.let_go(log.sparkSession)
    x = pairing.stage(iter([splits.temporal(log, "ts", "row").select("user_id", "item_id", (F.col("split") == "train").alias("early"))]), "split")
    pairing.drop(log)
    pairing.let_go(x.sparkSession)
    train = pairing.stage(iter([itemcf.pairs(x.where("early"), "user_id", "item_id")]), "train")
    held = x.where("NOT early").select(F.col("user_id").alias("group_id"), F.col("item_id").alias("candidate_id")).distinct().withColumn("relevance", F.lit(1))
    totals = held.groupBy("group_id").agg(F.count(F.lit(1)).alias("total"))
    sim = similarity(train, neighbours)
    best = itemcf.top_unseen(train, sim, k)
    if pairing.written(best):
        pairing.drop(train, sim)
    rec = best.select(F.col("u").alias("group_id"), F.col("item_id").alias("candidate_id"), (-F.col("rank")).cast("double").alias("score"))
    flat = rec.join(totals.select("group_id"), "group_id", "left_semi").join(held, ["group_id", "candidate_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    return ranking.summary(flat, ranking.group_metrics(flat, (5, k), totals), (5, k))


def encode(fit_on: DataFrame, df: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Vocabulary codes and z-scores fitted on one frame and applied to another."""
    for c in categorical:
        fitted = encoders.fit_vocabulary(fit_on, c).withColumnRenamed("code", f"{c}_code")
        df = encoders.apply_code(df, fitted, c, f"{c}_code")
    for c in numeric:
        df = df.crossJoin(F.broadcast(encoders.numeric_fit(fit_on, c))).withColumn(f"{c}_z", (F.col(c) - F.col("_mean")) / F.greatest(F.col("_std"), F.lit(1e-8))).drop("_lo", "_hi", "_mean", "_std")
    return df


def write_results(summary: DataFrame, path: str) -> None:
    """A result table as Parquet, CSV and JSON beside each other."""
    for fmt in ("parquet", "csv", "json"):
        tables.materialize(summary, f"{path}/summary.{fmt}", fmt, "none", mode="overwrite")


def html(title: str, frames: dict[str, DataFrame], most: int = 200) -> str:
    """A report page of small result tables; a table of more than ``most`` rows says that it is cut."""
    from html import escape

    out = [f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in frames.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        rows, more = tables._report_rows(df, most)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>" + (f"<p>The first {most} rows; the table has more.</p>" if more else ""))
    return "".join(out)


def index_page(title: str, reports: dict[str, str]) -> str:
    """A page of links to reports: title to relative path, newest name first."""
    from html import escape

    links = "".join(f'<li><a href="{escape(path, quote=True)}">{escape(name)}</a></li>' for name, path in sorted(reports.items(), reverse=True))
    return f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1><ul>{links}</ul>"


def find_reports(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".html", ".md")) -> dict[str, str]:
    """Reports in the folders below ``folder``, on any file system: their paths below it without the suffix, and their paths."""
    hadoop, out = spark.sparkContext._jvm.org.apache.hadoop.fs, {}
    at = hadoop.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root, files = fs.resolvePath(at).toUri().getPath().rstrip("/"), fs.listFiles(at, True)
    while files.hasNext():
        path = files.next().getPath().toUri().getPath()[len(root) + 1 :]
        if path.endswith(suffixes) and path.rsplit("/", 1)[-1] != "index.html":
            out[path.rsplit(".", 1)[0]] = path
    return out
