"""Clean a benchmark's splits: every record gets a verdict, and training reads the folder of those that are kept.

    python -m jobs.clean_splits --records documents.parquet --labels labels.parquet --out cleaned [--config clean_splits.json]

Records are joined to their labels (the largest of each column where an id is labelled more than once) and get a split.
Then, the first that holds is a record's verdict, and all that hold are its reasons:

* ``duplicate``: a record of its split with a smaller id has the same entity (null entities equal each other);
* ``contaminated``: it is in train or valid, and its entity is in test;
* ``conflict``: the labels of its entity disagree, within its split or between its split and another;
* ``alert``: it violates a rule;
* ``kept``.

Entities are compared by their SHA-256, so texts are shuffled once, to meet the table of entities. That table has a row
for each entity, so a hot one splits in the join (adaptive skew joins) and is combined before the shuffle in aggregations.

Output below ``--out``: ``records`` (Parquet, partitioned by split and verdict: the record's columns, its labels and
``reasons``) and ``summary`` (JSON: rows by split and verdict). A rerun overwrites both and gives the same; after a run that
was cut off (no ``_SUCCESS`` in ``summary``) just run it again. Records of a repeated id are judged each for itself.
"""

from __future__ import annotations

import argparse
import logging
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import load_config, logger, split_column
from splitlens.config import AuditConfig
from splitlens.functions.labels import SPLIT_BITS, split_bit
from splitlens.operators import alerts, conflicts, hygiene
from splitlens.session import get_session
from splitlens.sources.records import canonical, read_table

log = logger("clean_splits")
VERDICTS = ["duplicate", "contaminated", "conflict", "alert"]


def records_of(records: DataFrame, labels: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Canonical records with ``digest``, the entity's."""
    names = config["labels"]
    marks = labels.groupBy(config["id"]).agg(*[F.max(c).alias(c) for c in names])
    own = records.drop(*names).join(marks, config["id"], "left").withColumn("split", split_column(config["split"]))
    settings = AuditConfig("classification", columns={"entity": config["entity"], "id": config["id"]}, label_cols=names)
    return canonical(own, settings, F.col(config["id"])).withColumn("digest", F.sha2("entity", 256))


def entities(records: DataFrame) -> DataFrame:
    """A row for each entity: ``mask`` of its splits, ``kinds`` of conflicts, and its first record in each split."""
    narrow = records.select("split", "row_id", "label_key", F.col("digest").alias("entity"))
    firsts = narrow.groupBy("entity").agg(*[F.min(F.when(F.col("split") == s, F.col("row_id"))).alias(f"first_{s}") for s in SPLIT_BITS])
    found = hygiene.presence(narrow, "entity").select("entity", "mask")
    for other in (firsts, conflicts.classification_conflicts(narrow)):
        own = other.withColumnRenamed("entity", "__entity")
        found = found.join(own, F.col("entity").eqNullSafe(F.col("__entity")), "left").drop("__entity")
    return found.withColumnRenamed("entity", "__digest")


def judged(records: DataFrame, rules: alerts.RuleSet) -> DataFrame:
    """``records`` with ``verdict`` and ``reasons``."""
    known = alerts.screen(records, "entity", rules).join(entities(records), F.col("digest").eqNullSafe(F.col("__digest")), "left").drop("__digest")
    own = split_bit(F.col("split"))
    first = F.coalesce(*[F.when(F.col("split") == s, F.col(f"first_{s}")) for s in SPLIT_BITS])
    kinds = [F.array_contains("kinds", kind) & (own.bitwiseAND(a | b) != 0) for kind, (a, b) in conflicts.KINDS.items()]
    tests = {
        "duplicate": F.col("row_id") > first,
        "contaminated": F.col("entity").isNotNull() & (own != 4) & (F.col("mask").bitwiseAND(4) != 0),
        "conflict": reduce(lambda a, b: a | b, kinds),
        "alert": F.col("n_warnings") > 0,
    }
    reasons = F.filter(F.array(*[F.when(tests[v], F.lit(v)) for v in VERDICTS]), lambda v: v.isNotNull())
    out = known.withColumn("reasons", reasons).withColumn("verdict", F.coalesce(F.get("reasons", F.lit(0)), F.lit("kept")))
    return out.drop("mask", "kinds", "warnings", "first_warning", "digest", *[f"first_{s}" for s in SPLIT_BITS])


def _planned(spark: SparkSession, records_path: str, labels_path: str, config: dict[str, Any]) -> DataFrame:
    rules = alerts.RuleSet(alerts.Rule("config", r["name"], r["pattern"], int(r.get("most", 0))) for r in config.get("rules", []))
    return judged(records_of(read_table(spark, records_path), read_table(spark, labels_path), config), rules)


def cleaned(spark: SparkSession, records_path: str, labels_path: str, out: str, config: dict[str, Any] | None = None) -> DataFrame:
    """What a run has written, whether it was empty or not."""
    schema = _planned(spark, records_path, labels_path, config or load_config(None, "clean_splits")).schema
    return spark.read.schema(schema).parquet(f"{out}/records")


def run(spark: SparkSession, records_path: str, labels_path: str, out: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Writes records and summary below ``out``; returns how many records have each verdict."""
    config = config or load_config(None, "clean_splits")
    log.info("reading records from %s and labels from %s", records_path, labels_path)
    counted = Observation()
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    every = _planned(spark, records_path, labels_path, config).observe(counted, F.count(F.lit(1)).alias("records"), *[n(v) for v in [*VERDICTS, "kept"]])
    every.write.mode("overwrite").partitionBy("split", "verdict").parquet(f"{out}/records")
    totals = counted.get
    written = spark.read.schema(every.schema).parquet(f"{out}/records")
    written.groupBy("split", "verdict").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    log.info("read %d records", totals["records"])
    log.info("wrote %s to %s/records", ", ".join(f"{totals[v]} {v}" for v in [*VERDICTS, "kept"]), out)
    return totals


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clean_splits", description=__doc__.splitlines()[0])
    parser.add_argument("--records", required=True)
    parser.add_argument("--labels", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--config")
    args = parser.parse_args(argv)
    logging.basicConfig(level="INFO")
    spark = get_session("clean_splits")
    try:
        run(spark, args.records, args.labels, args.out, load_config(args.config, "clean_splits"))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
