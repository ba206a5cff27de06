"""Dataset overview: column groups by name, what kind of data it is, and how large."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The core columns, and the names that mark a rating or a time.
CORE = ("user_id", "item_id", "label_type", "label_time", "timestamp")
RATINGS = ("rating", "Rating", "score", "stars")
TIMES = ("timestamp", "time", "created_at")


def column_groups(columns: list[str]) -> dict[str, list[str]]:
    """core, user, item, domain and other columns, by name and prefix."""
    out: dict[str, list[str]] = {g: [] for g in ("core", "user", "item", "domain", "other")}
    for c in columns:
        group = "core" if c in CORE else next((g for g in ("user", "item", "domain") if c.startswith(f"{g}_")), "other")
        out[group].append(c)
    return out


def detect(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first of the names that is a column."""
    return next((n for n in names if n in columns), None)


def feedback_kind(df: DataFrame) -> str:
    """explicit (a rating column), implicit_binary or implicit (a label with two or more values), unknown."""
    if detect(df.columns, RATINGS):
        return "explicit"
    if "label_type" not in df.columns:
        return "unknown"
    n = df.select("label_type").where("label_type IS NOT NULL").distinct().limit(3).count()
    return "implicit_binary" if n == 2 else "implicit" if n else "unknown"


def sequence_kind(schema: T.StructType) -> str:
    """domain_seq, nested_seq (an array of structs), history_seq (another array of ids) or none."""
    arrays = [f for f in schema if isinstance(f.dataType, T.ArrayType)]
    if any(re.match(r"domain_[a-z]+_seq", f.name) for f in arrays):
        return "domain_seq"
    if any(isinstance(f.dataType.elementType, T.StructType) for f in arrays):
        return "nested_seq"
    return "history_seq" if any(isinstance(f.dataType.elementType, (T.LongType, T.IntegerType)) for f in arrays) else "none"


def modality(columns: list[str]) -> str:
    return "multimodal" if any("emb" in c.lower() for c in columns) else "single"


#: Bytes of a value by type.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def value_bytes(c: Column, kind: T.DataType) -> Column:
    """Bytes of a column's values as plain arrays: the type's width, also for nulls; texts and lists by their content."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + value_bytes(x, kind.elementType)), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((value_bytes(c[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
    return F.lit(16 if isinstance(kind, T.DecimalType) else WIDTHS.get(kind.simpleString(), 8)).cast("bigint")


def overview(df: DataFrame) -> DataFrame:
    """metric, value (text): rows, bytes (of the values, see value_bytes), columns, the sizes of the column groups, has_label, has_timestamp, feedback, sequence, modality."""
    groups = column_groups(df.columns)
    facts = {"columns": len(df.columns), **{f"{g}_columns": len(c) for g, c in groups.items()}, "has_label": "label_type" in df.columns, "has_timestamp": detect(df.columns, TIMES) is not None}
    facts |= {"feedback": feedback_kind(df), "sequence": sequence_kind(df.schema), "modality": modality(df.columns)}
    pairs = [F.struct(F.lit("rows").alias("metric"), F.col("n").cast("string").alias("value"))] + [F.struct(F.lit(k).alias("metric"), F.lit(str(v).lower()).alias("value")) for k, v in facts.items()]
    size = sum((value_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema), F.lit(0).cast("bigint"))
    pairs.append(F.struct(F.lit("bytes").alias("metric"), F.coalesce(F.col("b"), F.lit(0)).cast("string").alias("value")))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def feature_specs(df: DataFrame, columns: list[str], cap: int = 500_000) -> list[tuple[str, int, int, int]]:
    """(column, vocabulary, offset, length): vocabulary min(max + 1, cap + 1), offsets add up the lengths; one aggregation."""
    wide = df.agg(*(F.struct(F.max(F.array_max(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c)).alias("m"), F.max(F.size(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.lit(1)).alias("s")).alias(c) for c in columns)).first()
    out, offset = [], 0
    for c in columns:
        top, size = wide[c]["m"], wide[c]["s"]
        out.append((c, min((top or 0) + 1, cap + 1), offset, size or 0))
        offset += size or 0
    return out
