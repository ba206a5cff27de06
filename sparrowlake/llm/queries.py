"""The registered queries of the subpackage: one thin query for each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.llm import ann, bpe, contamination, licenses, lm, near_dup, rules, secrets, sharding, token_orc
from sparrowlake.plans.registry import Registry, table

REGISTRY = Registry()


def tokenizer_path() -> str:
    """The byte-level vocabulary file; a parameter of the operators, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(*columns) if columns else d


@REGISTRY.query("op3_bpe_codec")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@REGISTRY.query("op8_token_orc")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_orc.round_trip(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())
    return token_orc.crc32_of_ids(back).select("doc_id", "start", "n_tokens", "ids_crc32")


@REGISTRY.query("op9_feistel_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    done = sharding.shard(rows, ["doc_id", "size", "text_crc32"], 16)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@REGISTRY.query("op10_secret_ownership")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of a document is its source; its repository is the source's part in one language."""
    d = documents(spark, sf_dir, "doc_id", "text", "source", "lang").withColumn("repository", F.concat_ws("/", "source", "lang"))
    judged = secrets.judge(secrets.find(d).drop("text"), "source", "repository")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return judged.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def remainder(doc_id: str, m: int):
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % m


@REGISTRY.query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text")
    learnt = rules.fit(d, table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    return rules.classify(d, learnt).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@REGISTRY.query("op6_minhash_classes")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir, "doc_id", "text"), k=4)


#: Words and shingles in SQL: A-Z lowered, words between ASCII white space, 5-word shingles, or the whole sequence of a shorter text.
SQL_SHINGLES = """words AS (SELECT {id} AS id, list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
starts AS (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
{name} AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM starts)"""


def _sql_sets(name: str, source: str, key: str) -> str:
    return SQL_SHINGLES.format(id=key, text="text", table=source, name=name).replace("words", f"{name}_words").replace("starts", f"{name}_starts")


@REGISTRY.query(
    "op1_containment_leaks",
    f"""WITH {_sql_sets('d', 'documents', 'doc_id')}, {_sql_sets('b', 'benchmark', 'item_id')}, n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::INTEGER AS common, any_value(n.n)::INTEGER AS shingles FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING 100 * count(*) >= 80 * any_value(n.n)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.annotate(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"), short_inside=True)
    return found.select("doc_id", F.inline("leaks")).select("doc_id", "item_id", "common", "shingles")


@REGISTRY.query("op7_kmeans_tree_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@REGISTRY.query("op2_trie_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", remainder("doc_id", 7) == 2)
    model = lm.train(d.where(~F.col("held_out")))
    return lm.score(d, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@REGISTRY.query("op5_license_windows")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text"))
