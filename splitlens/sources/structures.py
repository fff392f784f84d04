"""Sequence registry and structure hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "sequence_id string, sequence string, sources array<struct<dataset:string, split:string, file:string>>"

#: Columns of a hit line by position.
HIT_COLUMNS = [
    ("query", "string"), ("target", "string"), ("score", "double"), ("probability", "double"), ("evalue", "double"),
    ("q_start", "int"), ("q_end", "int"), ("q_len", "int"), ("t_start", "int"), ("t_end", "int"), ("t_len", "int"),
]


def read_registry(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A JSON object per line; blank lines are skipped; a broken line is an error, or is left out unless ``strict``."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    lines = spark.read.text(path).where("trim(value) != ''").withColumn("line", F.monotonically_increasing_id())
    parsed = lines.select("line", F.from_json("value", REGISTRY, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r"))
    out = parsed.select("r.*", "line")
    return out if mode == "FAILFAST" else out.where("sequence_id is not null")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated hits without header; rows of fewer than 11 fields are skipped. ``line`` is the order in the file."""
    fields = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", "\t").alias("f")).where(F.size("f") >= len(HIT_COLUMNS))
    return fields.select(*[F.get("f", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(HIT_COLUMNS)], "line")
