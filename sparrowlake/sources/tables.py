"""Readers, writers, generators and the capability catalog."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.functions.columns import md5_word, uniform
from sparrowlake.operators.ordered import ID_STEPS, number_bucket, running

#: Formats that Spark writes here, with their codecs.
CODECS = {
    "parquet": ("none", "snappy", "zstd", "lz4", "gzip"),
    "orc": ("none", "snappy", "zstd", "lz4"),
    "csv": ("none", "gzip"),
    "json": ("none", "gzip"),
}

#: Names of an embedding table's id column, in order.
VECTOR_IDS = ("item_id", "anonymous_cid", "cid")


def load(spark: SparkSession, path: str, columns: list[str] | None = None, exclude: list[str] = []) -> DataFrame:  # noqa: B006
    """A table by its suffix: .parquet, .orc, .json, .csv (header, inferred types), .feather/.ipc/.arrow; ValueError for others."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc", "json"):
        df = getattr(spark.read, kind)(path)
    elif kind == "csv":
        df = spark.read.csv(path, header=True, inferSchema=True, samplingRatio=0.1)
    elif kind in ("feather", "ipc", "arrow"):
        df = feather(spark, path)
    else:
        raise ValueError(f"unknown table format: {path}")
    if columns:
        df = df.select(*columns)
    return df.drop(*exclude) if exclude else df


def feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather / Arrow IPC files: Spark lists and reads the bytes, PyArrow decodes them on the executors."""
    import pyarrow as pa
    import pyarrow.ipc as ipc

    files = spark.read.format("binaryFile").load(path)
    from pyspark.sql.pandas.types import from_arrow_schema

    def head(batches):  # only the schema of a file leaves its task
        for b in batches:
            for content in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"schema": pa.array([ipc.open_file(pa.BufferReader(content)).schema.serialize().to_pybytes()], pa.binary())})

    found = files.limit(1).select("content").mapInArrow(head, "schema binary").first()
    if found is None:
        raise ValueError(f"no files at {path}")
    schema = from_arrow_schema(ipc.read_schema(pa.BufferReader(bytes(found.schema))), prefer_timestamp_ntz=True)

    def decode(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                reader = ipc.open_file(pa.BufferReader(content))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    return files.select("content").mapInArrow(decode, schema)


def materialize(df: DataFrame, path: str, fmt: str = "parquet", codec: str = "snappy", partition_by: list[str] = [], sort_by: list[str] = [], row_group_bytes: int = 128 << 20, mode: str = "errorifexists") -> None:  # noqa: B006
    """Write a table; the codec is honoured or rejected. ``partition_by`` makes folders, ``sort_by`` orders rows within files."""
    if fmt not in CODECS or codec not in CODECS[fmt]:
        raise ValueError(f"{fmt} can't be written with {codec}")
    if partition_by:
        df = df.repartition(*partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    w = df.write.mode(mode).format(fmt).option("compression", "uncompressed" if codec == "none" and fmt == "parquet" else codec).option("parquet.block.size", row_group_bytes)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def materialize_bucketed(df: DataFrame, table: str, bucket_by: list[str], buckets: int, sort_by: list[str] = [], mode: str = "overwrite") -> None:  # noqa: B006
    """A catalog table bucketed (and sorted) by keys, so that joins on them need no shuffle."""
    w = df.write.mode(mode).format("parquet").bucketBy(buckets, *bucket_by)
    (w.sortBy(*sort_by) if sort_by else w).saveAsTable(table)


def sidecar(df: DataFrame) -> dict:
    """What a table's metadata file states: columns, types, rows."""
    return {"columns": [{"name": n, "type": t} for n, t in df.dtypes], "rows": df.count()}


def jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, fetch_size: int = 100_000, **options: str) -> DataFrame:
    """A database query, paged by ``fetch_size``, in parallel ranges of a column if given (the last range is open, so the largest value is kept)."""
    reader = lambda: spark.read.format("jdbc").options(url=url, fetchsize=str(fetch_size), **options)
    if partition_column is None:
        return reader().option("query", query).load()
    if bounds is None:
        one = reader().option("query", f"SELECT min({partition_column}) AS lo, max({partition_column}) AS hi FROM ({query}) q").load().first()
        bounds = (one[0] or 0, (one[1] or 0) + 1)
    r = reader().option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
    return r.option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions).load()


def json_lists(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of lists as (user_idx, items): one user for each inner list. The file is one JSON value, so one task reads it; larger data come as a table."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<array<bigint>>")).alias("user_idx", "items"))


def from_raw(spark: SparkSession, raw: dict, max_rows: int = 500_000, seed: int = 42) -> tuple[DataFrame, dict | None]:
    """The table in what a loader returns, and what is known of its sampling: the value under ``dataset``, ``seq`` or ``train``, in that order, else the first one that is a table.

    Tables are Spark, Arrow or pandas frames; a list of lists is (user_id, item_id), one
    user for each inner list; a text is a path. More than ``max_rows`` rows are sampled
    by the hash of the whole row.
    """
    for value in (*(raw[k] for k in ("dataset", "seq", "train") if k in raw), *raw.values()):
        if isinstance(value, str):
            df = load(spark, value)
        elif isinstance(value, DataFrame):
            df = value
        elif isinstance(value, list) and value and isinstance(value[0], list):
            lists = spark.createDataFrame([(u, [int(i) for i in items]) for u, items in enumerate(value)], "user_id long, items array<long>")
            df = lists.select("user_id", F.explode("items").alias("item_id"))
        elif hasattr(value, "column_names") or hasattr(value, "to_dict"):  # Arrow or pandas, which the driver holds already
            df = spark.createDataFrame(value)
        else:
            continue
        n = df.count()
        if n <= max_rows:
            return df, None
        drawn = df.withColumn("_h", F.xxhash64(F.lit(seed), F.to_json(F.struct(*df.columns)))).orderBy("_h").limit(max_rows).drop("_h")
        return drawn, {"original_rows": n, "sampled_at_load": True}
    raise ValueError("no table under any key")


#: The parts of a dataset by the key that each has and the key that joins it: None stands for the part the others join.
SUBSETS = {
    "seq": {"primary_key": "user_id", "join_key": None},
    "user_feat": {"primary_key": "user_id", "join_key": "user_id"},
    "item_feat": {"primary_key": "item_id", "join_key": "item_id"},
}


def join_subsets(parts: dict[str, DataFrame], subsets: dict[str, dict] = SUBSETS) -> DataFrame:
    """The part without a join key, left-joined with each other part on the key its descriptor states; clashing names get the part's name before them."""
    main = next(n for n in parts if subsets[n]["join_key"] is None)
    out = parts[main]
    for name, df in parts.items():
        if name != main:
            key = subsets[name]["join_key"]
            out = out.join(df.select(key, *(F.col(f"`{c}`").alias(f"{name}_{c}" if c in out.columns else c) for c in df.columns if c != key)), key, "left")
    return out


def vector_columns(schema: T.StructType) -> tuple[str | None, str]:
    """(id column, vector column) of an embedding table: the first array column, and the first of VECTOR_IDS or the first scalar."""
    vector = next((f.name for f in schema if isinstance(f.dataType, T.ArrayType)), None)
    if vector is None:
        raise ValueError("no vector column")
    scalars = [f.name for f in schema if not isinstance(f.dataType, T.ArrayType)]
    return next((c for c in VECTOR_IDS if c in scalars), scalars[0] if scalars else None), vector


def synthetic(spark: SparkSession, users: int, items: int, draws: int, power: float = 0.75, seed: int = 42) -> DataFrame:
    """Distinct (user_id, item_id, label) pairs; popularity of both sides falls as rank^-power. Draws meet the cumulative chances cell by cell."""

    def spans(n: int, name: str) -> DataFrame:
        w = spark.range(1, n + 1).select(F.col("id").alias(name), F.pow(F.col("id").cast("double"), F.lit(-power)).alias("w"))
        cum = running(w, number_bucket(F.col(name), ID_STEPS), [F.col(name)], ["w"]).crossJoin(F.broadcast(w.agg(F.sum("w").alias("t"))))
        x = cum.select(name, ((F.col("cum_w") - F.col("w")) / F.col("t")).alias("lo"), (F.col("cum_w") / F.col("t")).alias("hi"))
        return x.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * 1024), F.least(F.floor(F.col("hi") * 1024), F.lit(1023)))))

    def pick(df: DataFrame, n: int, name: str) -> DataFrame:
        u = uniform(F.lit(seed), F.lit(name), F.col("draw"))
        return df.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * 1024)).join(spans(n, name), "cell").where("u >= lo AND u < hi").drop("u", "cell", "lo", "hi")

    x = pick(pick(spark.range(draws).withColumnRenamed("id", "draw"), users, "user_id"), items, "item_id")
    return x.select("user_id", "item_id").distinct().withColumn("label", F.lit(1))


def benchmark_rows(spark: SparkSession, rows: int, columns: int = 6, seed: int = 42) -> DataFrame:
    """user_id, item_id, label and feature columns that are categorical, float and integer in turn."""
    h = lambda name: md5_word(F.lit(seed), F.lit(name), F.col("id"))
    out: list[Column] = [(h("user") % max(1, rows // 10)).alias("user_id"), (h("item") % max(1, rows // 5)).alias("item_id"), (h("label") % 2).cast("float").alias("label")]
    for i in range(columns):
        x = h(f"f{i}")
        out.append([F.concat(F.lit("cat_"), (x % 100).cast("string")).alias(f"feat_cat_{i}"), (x.cast("double") / 4294967296.0).alias(f"feat_float_{i}"), (x % 1000).cast("int").alias(f"feat_int_{i}")][i % 3])
    return spark.range(rows).select(*out)


def downcast_plan(df: DataFrame, category_ratio: float = 0.5) -> dict[str, str]:
    """The narrowest type of each column, from one aggregation: integers by their range, doubles as float, repetitive strings as 'category' (dictionary coded)."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *(F.struct(F.min(c), F.max(c)).alias(c) for c in ints), *(F.approx_count_distinct(c).alias(c) for c in texts)).first()
    plan = {f.name: "float" for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    for c in ints:
        lo, hi = row[c]
        if lo is not None:
            plan[c] = next(t for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << b) <= lo and hi < 1 << b)
    return plan | {c: "category" for c in texts if row["_n"] and row[c] / row["_n"] < category_ratio}


def apply_downcast(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).cast(plan[c]).alias(c) if plan.get(c, "category") != "category" else F.col(c) for c in df.columns))


def capabilities(spark: SparkSession) -> DataFrame:
    """kind, name: the formats, codecs, samplers and metrics that the library offers."""
    rows = [("format", f) for f in (*CODECS, "feather", "jdbc")] + [("codec", f"{f}:{c}") for f, cs in CODECS.items() for c in cs]
    rows += [("sampler", s) for s in ("uniform", "stratified", "tail", "hybrid", "popularity", "in_batch", "hard", "weighted_order")] + [("metric", m) for m in ("cosine", "l2", "ip")]
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in rows))).alias("r")).select("r.*")


def _report_rows(df: DataFrame, most: int) -> tuple[list, bool]:
    """At most ``most`` rows of a report, and whether the table has more."""
    rows = df.limit(most + 1).collect()
    return rows[:most], len(rows) > most


def markdown(title: str, frames: dict[str, DataFrame], most: int = 100) -> str:
    """A report of small result tables; a table of more than ``most`` rows says that it is cut."""
    out = [f"# {title}"]
    for name, df in frames.items():
        rows, more = _report_rows(df, most)
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]
        out += [f"\nThe first {most} rows; the table has more."] if more else []
    return "\n".join(out) + "\n"


def charts(frames: dict[str, DataFrame], most: int = 5000) -> dict[str, str]:
    """Each result table as a JSON document for a chart (``cut``: it has more rows than ``most``); empty ones are skipped."""
    out = {}
    for name, df in frames.items():
        rows, more = _report_rows(df, most)
        if rows:
            out[name] = json.dumps({"name": name, "columns": df.columns, "rows": [r.asDict(True) for r in rows], "cut": more}, default=str)
    return out
