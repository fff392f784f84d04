"""Command: collect the target sequences of drug-target configs in a registry, and export it.

    python -m splitlens.registry --configs configs/dti --out sequences [--fasta] [--csv] [--fold-jobs]

Each sequence of any config's records is one row of ``registry`` (JSON lines) with an id and its sources; the exports are folders
of part files beside it. An audit reads the registry by ``info.unique_sequences_jsonl``.
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlens import config as cfg
from splitlens import sinks
from splitlens.operators.targets import build_registry
from splitlens.session import get_session
from splitlens.sources.records import load

log = logging.getLogger("splitlens")


def collected(spark: SparkSession, configs: list[Path]) -> DataFrame | None:
    """``order``, ``dataset``, ``split``, ``file`` and ``sequence`` of the records of all drug-target configs, in their order."""
    found = None
    for no, path in enumerate(configs):
        settings = cfg.audit_config(cfg.load_yaml(path))
        if not settings.is_dti:
            log.info("%s has no sequences, left out", path)
            continue
        rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
        file = settings.path or F.coalesce(*[F.when(F.col("split") == s, F.lit(p)) for s, p in (settings.paths or {}).items()])
        own = load(spark, settings).select(
            F.struct(F.lit(no).alias("no"), rank.alias("rank"), "row_id").alias("order"), F.lit(settings.name or path.stem).alias("dataset"), "split", (F.lit(file) if isinstance(file, str) else file).alias("file"), F.col("target_seq").alias("sequence")
        )
        found = own if found is None else found.unionByName(own)
    return found


def run(spark: SparkSession, configs: list[Path], out: str, fasta: bool = False, csv: bool = False, fold_jobs: bool = False) -> int:
    """Writes the registry and the exports asked for below ``out``; returns the number of sequences."""
    sequences = collected(spark, configs)
    if sequences is None:
        raise ValueError("no config has sequences")
    path = f"{out}/registry"
    build_registry(sequences).write.mode("overwrite").json(path)
    registry = spark.read.schema("sequence_id string, sequence string, sources array<struct<dataset:string,split:string,file:string>>").json(path)
    for wanted, name, write in ((fasta, "fasta", sinks.write_fasta), (csv, "csv", sinks.write_sequences_csv), (fold_jobs, "fold_jobs", sinks.write_fold_jobs)):
        if wanted:
            write(registry, f"{out}/{name}")
    n = registry.count()
    log.info("wrote %d sequences of %d configs to %s", n, len(configs), out)
    return n


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="splitlens.registry", description=__doc__.splitlines()[0])
    parser.add_argument("--configs", type=Path, required=True)
    parser.add_argument("--out", required=True)
    for flag in ("--fasta", "--csv", "--fold-jobs"):
        parser.add_argument(flag, action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level="INFO")
    found = cfg.discover(args.configs)
    if not found:
        log.error("no configs found in %s", args.configs)
        return 1
    spark = get_session("splitlens-registry")
    try:
        run(spark, found, args.out, args.fasta, args.csv, args.fold_jobs)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
