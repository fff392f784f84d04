"""Command line: audit one config or a folder of them."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from splitlens import config as cfg
from splitlens import sinks
from splitlens.operators.alerts import rules_from, screen
from splitlens.operators.alignment import Scoring
from splitlens.operators import boosting
from splitlens.operators.baselines import run_baselines
from splitlens.operators.standardize import cleaner, valid_only
from splitlens.plans.audit import AuditResult, audit, audit_targets
from splitlens.session import get_session
from splitlens.sources.records import load, read_table
from splitlens.sources.structures import read_hits, read_registry

log = logging.getLogger("splitlens")


def write_result(result: AuditResult, folder: Path, single: bool = True) -> dict[str, Path | None]:
    """Files of a result, one each, or folders of part files unless ``single`` (``info.single_files``)."""
    written = {"records": sinks.write_records(result.records, folder / "records.csv", single)}
    for name, rows in (("conflicts", result.conflicts), ("cliffs", result.cliffs), ("sequence_alignments", result.sequence_alignments), ("structure_alignments", result.structure_alignments)):
        written[name] = sinks.write_rows(rows, folder / f"{name}.jsonl", single) if rows is not None else None
    written["summary"] = sinks.write_json(result.summary, folder / "summary.json")
    return written


def benchmark_result(result: AuditResult, settings: cfg.AuditConfig, folder: Path) -> dict:
    """Metrics of every model, and the name of the file that holds its predictions. An error is a result, too."""
    try:
        done = run_baselines(result.records, settings.task, seed=settings.seed, fp_bits=settings.fp_bits, rounds=int(settings.info.get("boosting_rounds", boosting.ROUNDS)))
        for name, model in done["models"].items():
            path = sinks.write_rows(model["predictions"], folder / f"predictions-{name}.jsonl", bool(settings.info.get("single_files", True)))
            model["predictions"] = path.name if path else None
        return done
    except Exception as e:
        return {"error": str(e)}


def screened(spark: SparkSession, records: DataFrame, settings: cfg.AuditConfig) -> DataFrame:
    """``records`` with alerts, where ``info.alerts`` names a table of rules: its ``path``, and which of them hold by ``set``,
    ``min_priority`` and ``without`` (names)."""
    chosen = settings.info.get("alerts")
    if not chosen:
        return records
    rules = rules_from(read_table(spark, chosen["path"]))
    rules = rules.choose(chosen["set"]) if chosen.get("set") else rules
    rules = rules.at_least(int(chosen["min_priority"])) if chosen.get("min_priority") is not None else rules
    for name in chosen.get("without", []):
        rules = rules.without(name)
    return screen(records, "entity", rules)


def run_one(spark: SparkSession, path: Path, out_root: Path, configs_root: Path | None = None, force: bool = False, benchmark: bool = False) -> Path:
    """Audit one config, unless its files are there; baselines' errors are part of their result."""
    raw = cfg.load_yaml(path)
    folder = cfg.output_dir(raw, out_root, path, configs_root)
    if not force and sinks.is_done(folder, benchmark):
        log.info("%s is there, skipped", folder)
        return folder
    settings = cfg.audit_config(raw)
    records = load(spark, settings)
    clean = cleaner(settings.info.get("cleaner"))
    records = screened(spark, clean(records) if clean else records, settings)
    if not settings.keep_invalid:
        if "target_seq" in records.columns:
            raise ValueError("records with sequences keep their invalid rows")
        records = valid_only(records)
    if settings.is_dti:
        known = bool(settings.registry_path and settings.hits_path)
        registry = read_registry(spark, settings.registry_path) if known else None
        hits = read_hits(spark, settings.hits_path) if known else None
        result = audit_targets(records, settings, registry, hits, Scoring() if settings.info.get("align") else None)
    else:
        result = audit(records, settings)
    try:
        result.summary["config"] = cfg.echo(raw)
        log.info("%s: %s", path, ", ".join(f"{n} {split}" for split, n in result.summary["counts"].items() if n is not None))
        files = [p.name for p in write_result(result, folder, bool(settings.info.get("single_files", True))).values() if p]
        if benchmark:
            done = benchmark_result(result, settings, folder)
            files += [sinks.write_json(done, folder / "performance.json").name, *[m["predictions"] for m in done.get("models", {}).values() if m["predictions"]]]
        sinks.write_manifest(folder, files)  # last: it says that all is there
    finally:
        result.release()
    log.info("%s: wrote %s to %s", path, ", ".join(files), folder)
    return folder


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="splitlens", description=__doc__)
    parser.add_argument("--config", type=Path)
    parser.add_argument("--configs", type=Path)
    parser.add_argument("--out-root", type=Path, default=Path("runs"))
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--benchmark", action="store_true")
    parser.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    args = parser.parse_args(argv)
    if bool(args.config) == bool(args.configs):
        parser.error("give either --config or --configs")
    logging.basicConfig(level=args.log_level)
    found = cfg.discover(args.configs, args.config)
    if not found:
        log.error("no configs found in %s", args.configs or args.config)
        return 1
    spark, failed = get_session(), 0
    for path in found:
        try:
            run_one(spark, path, args.out_root, args.configs, args.force, args.benchmark)
        except Exception:
            failed += 1
            log.exception("%s failed", path)
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
