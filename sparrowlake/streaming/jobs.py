"""Structured Streaming versions of the windowed profiles and encoders.

Each job reads a file source, runs until its input is used up (availableNow), and
writes its updates batch by batch into a table in the shared folder; the result is the
last state of each key. Batches can be repeated after a failure: a batch's rows carry
its number, and the number's folder is overwritten.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where it is unset and all run on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
    base = base or f"file://{tempfile.mkdtemp(prefix='sparrowlake-')}"
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A Parquet file or folder as a stream, a few files at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a single file can't be a stream's base path


def run(stream: DataFrame, mode: str, keys: list[str] | None, each: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Run a streaming query over what there is and return its table: all rows, or each key's last state."""
    spark = stream.sparkSession
    base = work_dir(spark)

    def write(batch: DataFrame, number: int) -> None:
        each(batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/out/number={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("number")
    if keys is None:
        return out.drop("batch")
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")


def tumbling_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "40 days") -> DataFrame:
    """window_start, key, n."""
    x = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    counts = x.groupBy(F.window("_t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return run(counts.select(F.col("w.start").alias("window_start"), key, "n"), "update", ["window_start", key])


def sliding_counts(stream: DataFrame, ts: str, width: str, step: str, late: str = "40 days") -> DataFrame:
    x = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    counts = x.groupBy(F.window("_t", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return run(counts.select(F.col("w.start").alias("window_start"), "n"), "update", ["window_start"])


def sessions(stream: DataFrame, ts: str, user: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """user, start, end (last event plus the gap), n, of the sessions that are closed: those the watermark has passed."""
    x = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    s = x.groupBy(F.session_window("_t", gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return run(s.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"), "append", None)


def incremental_counts(stream: DataFrame, key: str, target: Column) -> DataFrame:
    """key, n, total: the mergeable state of frequency and target encoders."""
    return run(stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("total")), "update", [key])


def transformed(stream: DataFrame, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of a stream after a batch function: the chunk callback of a chunked reader."""
    return run(stream, "append", None, each)
