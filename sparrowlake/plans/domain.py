"""The test tables as interaction data: as DataFrames, and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.plans.registry import table

LOG = "SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, l_orderkey * 10 + l_linenumber AS row_id, (floor((l_quantity - 1) / 10) + 1)::INTEGER AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
#: A wide table with missing values: the test tables have none, so they are made by rule.
WIDE = """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.n_chars END AS chars, CASE WHEN d.doc_id % 7 < 2 OR quality = 0 THEN NULL ELSE d.lang END AS lang,
CASE WHEN d.doc_id % 3 = 0 OR d.doc_id % 10 = 1 THEN NULL ELSE d.source END AS source, CASE WHEN d.doc_id % 11 <> 0 THEN NULL ELSE d.doc_id END AS user_int_key, quality, toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction log (user_id, item_id, ts, row_id, rating) that orders and lineitem hold."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    rating = (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("int").alias("rating")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), rating)
    return o.join(l, "o_orderkey").select("user_id", "item_id", "ts", "row_id", "rating")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, and values missing by rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    x = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return x.select(
        "doc_id", F.when(i % 3 != 0, F.col("n_chars")).alias("chars"), F.when(~((i % 7 < 2) | F.coalesce(F.col("quality") == 0, F.lit(False))), F.col("lang")).alias("lang"),
        F.when(~((i % 3 == 0) | (i % 10 == 1)), F.col("source")).alias("source"), F.when(i % 11 == 0, i).alias("user_int_key"), "quality", "toxic",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
