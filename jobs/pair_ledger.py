"""Keep a ledger of (entity, target) pairs that leak between splits or whose labels disagree, as new records arrive.

    python -m jobs.pair_ledger --records lineitem/ --out ledger --checkpoint ledger-checkpoint [--config pair_ledger.json]

Each run takes the files that are new since the last one (a file stream with a checkpoint, until nothing is left) and
ends. A batch of new records is aggregated to one row for each pair, label and split, which is written to
``deltas/batch=<number>``; then the ledger is made anew for the buckets of pairs that the batch touches, from their
deltas, and replaces these partitions of ``ledger``. Raw records are read once; a run without new files writes nothing.

A batch that failed half way is run again under its number: it overwrites its own deltas and makes the same buckets anew, so
no record counts twice. Whatever way the files come in batches, the ledger is that of all records. A file that is written
again under its old name is not new.

``ledger`` (Parquet, partitioned by ``bucket``) has a row for each pair that is in more than one split or in conflict:
``entity``, ``target_seq``, ``n_rows``, ``n_labels``, ``mask`` of its splits (1 train, 2 valid, 4 test), ``first_row``, ``cross_split``
and ``kinds`` of conflicts. Pairs with a null side count as pairs.
"""

from __future__ import annotations

import argparse
import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import load_config, logger, split_column
from splitlens.config import AuditConfig
from splitlens.functions.labels import split_bit
from splitlens.operators import conflicts
from splitlens.session import get_session
from splitlens.sources.records import canonical
from splitlens.streaming.incremental import files

log = logger("pair_ledger")
PAIR = ["entity", "target_seq"]
LEDGER = "entity string, target_seq string, n_rows long, n_labels long, mask int, first_row long, cross_split boolean, kinds array<string>, bucket int"


def deltas(records: DataFrame, config: dict[str, Any]) -> DataFrame:
    """New records to a row for each pair, label and split: ``n`` of them and the first."""
    own = records.withColumn("split", split_column(config["split"])).withColumn("__target", F.expr(config["target"]).cast("string"))
    settings = AuditConfig("classification", "dti", columns={"entity": config["entity"], "label": config["label"], "sequence": "__target"})
    named = canonical(own, settings, F.expr(config["row_id"]))
    bucket = F.pmod(F.xxhash64(*PAIR), F.lit(int(config["buckets"]))).cast("int").alias("bucket")
    return named.groupBy(*PAIR, "label_key", "split", bucket).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


def ledger(found: DataFrame) -> DataFrame:
    """Deltas of whole pairs to their rows of the ledger."""
    pairs = found.groupBy("bucket", *PAIR).agg(
        F.sum("n").alias("n_rows"), F.countDistinct("label_key").alias("n_labels"), F.bit_or(split_bit(F.col("split"))).alias("mask"), F.min("first_row").alias("first_row")
    )
    kinds = conflicts.classification_conflicts(found, PAIR).select(*[F.col(c).alias(f"__{c}") for c in PAIR], F.array_sort("kinds").alias("kinds"))
    same = F.col("entity").eqNullSafe(F.col("__entity")) & F.col("target_seq").eqNullSafe(F.col("__target_seq"))
    cross = (F.bit_count("mask") > 1).alias("cross_split")
    every = pairs.join(kinds, same, "left").select(*pairs.columns, cross, F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    return every.where("cross_split or size(kinds) > 0")


def take(batch: DataFrame, number: int, out: str, config: dict[str, Any]) -> int:
    """One batch of new records: its deltas, then the buckets that it touches. Returns how many records it has."""
    spark = batch.sparkSession
    own = deltas(batch, config).withColumn("batch", F.lit(number))
    replace = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    replace(own, "batch", "bucket").parquet(f"{out}/deltas")
    schema = own.schema
    every = spark.read.schema(schema).parquet(f"{out}/deltas")
    new = every.where(F.col("batch") == number).groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket at most
    touched = sorted(r.bucket for r in new)
    if touched:
        replace(ledger(every.where(F.col("bucket").isin(touched))), "bucket").parquet(f"{out}/ledger")
    log.info("batch %d: wrote %d of %d buckets to %s/ledger", number, len(touched), int(config["buckets"]), out)
    return sum(r.n for r in new)


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{out}/ledger")


def run(spark: SparkSession, records_path: str, out: str, checkpoint: str, config: dict[str, Any] | None = None) -> int:
    """Takes what is new below ``records_path``; returns how many records that were."""
    config = config or load_config(None, "pair_ledger")
    stream = files(spark, records_path, maxFilesPerTrigger=int(config.get("max_files_per_batch", 1000)))
    spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("bucket").parquet(f"{out}/ledger")  # the first run's
    log.info("reading what is new in %s", records_path)
    read: list[int] = []
    each = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: read.append(take(batch, number, out, config)))
    each.start().awaitTermination()
    log.info("read %d new records in %d batches", sum(read), len(read))
    return sum(read)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pair_ledger", description=__doc__.splitlines()[0])
    parser.add_argument("--records", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--config")
    args = parser.parse_args(argv)
    logging.basicConfig(level="INFO")
    spark = get_session("pair_ledger")
    try:
        run(spark, args.records, args.out, args.checkpoint, load_config(args.config, "pair_ledger"))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
