"""The corpus pipeline: documents through five stages, each written and read again.

quality: documents that the rule ensemble itself rejects (predicted 0) go. near_duplicates: one
document of each class (5-word shingles, similarity 0.8 or more) stays, the one with the
smallest id. decontamination: documents that contain a benchmark item go. secrets:
documents stay, with their secrets replaced. bpe: the token ids of each document.

All stages but the last return the columns of ``documents``; others that the table has
go at the first stage. Nulls: a null text is empty; a row without doc_id is nobody's
duplicate and stays. Repeated rows of one id: the near-duplicate stage keeps one, the
first by text, language, source and length. Ties: equal texts under several ids are one
class, of which the smallest id stays. Very long texts are one row in every stage. An
empty table gives no rows; without labels every score is 0.5, and all documents stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.llm import bpe, contamination, near_dup, rules, secrets
from sparrowlake.llm.common import stage
from sparrowlake.llm.queries import remainder, tokenizer_path
from sparrowlake.plans.registry import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT_BELOW = rules.ACCEPT_FROM


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnt = rules.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    return rules.classify(docs, learnt).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dup.classes(docs, k=5).where("NOT kept").select("doc_id").distinct()
    # repeated rows of one id have one class: the first by text stays
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    single = docs.join(gone, "doc_id", "left_anti")
    if again.isEmpty():
        return single.select(*COLUMNS)
    rest = single.join(again, "doc_id", "left_anti")
    first = single.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return rest.unionByName(first).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.annotate(docs, table(spark, sf_dir, "benchmark"), short_inside=True).where(F.size("leaks") == 0).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.find(docs.withColumn("_repository", F.concat_ws("/", "source", "lang")))
    return secrets.redact(secrets.judge(found, "source", "_repository")).select(*COLUMNS)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(docs, tokenizer_path())
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("bpe", bpe_codec)]

#: Rules learnt from data, components and BPE are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs, _ = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
