"""The audit: canonical records in, a summary and row tables out. Row tables are lazy."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.config import AuditConfig
from splitlens.operators import alignment, cliffs, conflicts, hygiene, neighbors, structures, targets

log = logging.getLogger("splitlens")


@dataclass
class AuditResult:
    summary: dict[str, Any]
    records: DataFrame
    conflicts: DataFrame
    cliffs: DataFrame
    sequence_alignments: DataFrame | None = None
    structure_alignments: DataFrame | None = None
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Frees what the row tables are computed from; they are written by then."""
        for df in self.held:
            df.unpersist()


def _first(df: DataFrame) -> dict[str, Any]:
    row = df.first()
    return row.asDict(recursive=True) if row else {}


def _similarity(records: DataFrame, config: AuditConfig, has_valid: bool) -> dict[str, Any]:
    if "fp" not in records.columns:
        empty = {"mean": None, "std": None, "n": 0}
        return {"valid_to_train": dict(empty) if has_valid else None, "test_to_train": dict(empty), "test_to_trainvalid": dict(empty)}
    bits = records.withColumnRenamed("fp", "bits")
    part = lambda *s: bits.where(F.col("split").isin(*s)).select("bits")
    near = lambda q, r: _first(neighbors.nearest_summary(q, r, config.fp_bits))
    return {
        "valid_to_train": near(part("valid"), part("train")) if has_valid else None,
        "test_to_train": near(part("test"), part("train")),
        "test_to_trainvalid": near(part("test"), part("train", "valid")),
    }


def audit(records: DataFrame, config: AuditConfig) -> AuditResult:
    """Property audit. ``records`` feeds every operator; it is kept on disk where memory doesn't hold it."""
    records = records.persist(StorageLevel.MEMORY_AND_DISK)
    counts = _first(hygiene.split_counts(records))
    has_valid = counts["valid"] is not None
    entity = _first(hygiene.overlap(records, "entity"))
    warned = _first(hygiene.warning_stats(records))
    labels = sorted(hygiene.label_stats(records).collect(), key=lambda r: r.pos)
    sigma3 = hygiene.three_sigma(records) if config.task == "regression" else None
    found = conflicts.classification_conflicts(records) if sigma3 is None else conflicts.regression_conflicts(records, sigma3)
    rows = cliffs.cliff_rows(records, config.threshold, config.task, sigma3)
    n = {r.kind: r.n for r in cliffs.cliff_counts(records, config.threshold, config.task, sigma3).collect()}
    scalar = len(labels) <= 1
    mean, std = [r.mean for r in labels], [r.std if r.std is not None else 0.0 for r in labels]
    weight = _first(hygiene.population_stats(records.where(hygiene.in_tv()), "weight")) if "weight" in records.columns else {}
    one = lambda x: (x[0] if x else None) if scalar else x
    summary = {
        "counts": counts,
        "hygiene": {
            "n_all": entity["n_rows"],
            "n_unique": entity["n_unique"],
            "n_duplicate": entity["n_duplicates"],
            "n_contaminated_tv_vs_test": entity["shared_tv_test"],
            "warnings_mean": warned["mean"],
            "warnings_std": warned["std"],
        },
        "similarity": _similarity(records, config, has_valid),
        "task": {"type": config.task, "label_tv_mean": one(mean), "label_tv_std": one(std), "label_tv_3sigma": None if sigma3 is None else one(sigma3), "size_tv_mean": weight.get("mean"), "size_tv_std": weight.get("std")},
        "conflicts": _first(conflicts.conflict_counts(found)),
        "cliffs": {"intra_train_valid": n.get("intra_tv", 0), "intra_test": n.get("intra_test"), "cross_tv_test": n.get("cross_tv_test"), "sim_threshold": config.threshold},
    }
    return AuditResult(summary, records, conflicts.conflict_rows(records, found), rows, held=[records])


def audit_targets(records: DataFrame, config: AuditConfig, registry: DataFrame | None = None, hits: DataFrame | None = None, scoring: alignment.Scoring | None = None) -> AuditResult:
    """Drug-target audit: the property audit on entities, and targets, their alignment (where ``scoring`` is given) and
    their structures (where registry and hits are)."""
    result = audit(records, config)
    records, summary = result.records, result.summary
    empty = records.where("target_seq is null or target_seq = ''").count()
    if empty:
        log.warning("%d records without sequence", empty)
    own = _first(hygiene.overlap(records, "target_seq"))
    entity = _first(hygiene.overlap(records, "entity"))
    has_valid = summary["counts"]["valid"] is not None
    multi = targets.multi_entity_targets(records)
    n_pairs, n_multi = targets.cross_split_pairs(records).count(), multi.count()
    summary["drugs"] = {k: v for k, v in entity.items() if k.startswith(("unique", "shared"))}
    summary["targets"] = {
        "unique_counts": {s: own[f"unique_{s}"] if s != "valid" or has_valid else None for s in ("train", "valid", "test")},
        "shared_counts": {k: own[k] if "valid" not in k or has_valid else None for k in own if k.startswith("shared")},
        "hygiene": {"n_all": own["n_rows"], "n_unique": own["n_unique"], "n_duplicate": own["n_duplicates"], "n_contaminated_tv_vs_test": own["shared_tv_test"], "duplicates_by_split": {s: own[f"duplicates_{s}"] for s in ("train", "valid", "test")}},
        "conflicts": {"cross_split_pairs": n_pairs, "multi_entity": n_multi},
        "examples": [r.asDict() for r in targets.top_multi_entity_targets(records).collect()],
        "similarity": None,
        "structures": None,
    }
    summary["conflicts"] |= {"cross_split_pairs": n_pairs, "target_multi_entity": n_multi}
    extra = targets.cross_split_pair_rows(records).unionByName(targets.multi_entity_target_rows(records))
    result.conflicts = result.conflicts.unionByName(extra)
    if scoring is not None:
        seqs = lambda s: records.where(F.col("split") == s).select(F.col("target_seq").alias("seq"))
        done, named, bests = None, {}, {}

        def best_of(query: str, reference: str) -> DataFrame:
            """Each pair of splits is aligned once, whatever comparisons it is part of."""
            if (query, reference) not in bests:
                bests[query, reference] = alignment.nearest_sequences(seqs(query), seqs(reference), scoring).drop("n_aligned").persist(StorageLevel.MEMORY_AND_DISK)
                result.held.append(bests[query, reference])
            return bests[query, reference]

        for no, (q, r, qn, rn) in enumerate(structures.COMPARISONS):
            if "valid" in q and not has_valid:
                named["valid_to_train"] = None
                continue
            parts = [best_of(x, y) for x in q for y in r]
            best = alignment.best_alignments(reduce(DataFrame.unionByName, parts)).withColumns({"comparison": F.lit(no), "split_query": F.lit(qn), "split_reference": F.lit(rn)})
            named[f"{qn}_to_{rn.replace('_', '')}"] = _first(alignment.alignment_summary(best))
            done = best if done is None else done.unionByName(best)
        summary["targets"]["similarity"] = named
        result.sequence_alignments = alignment.top_alignments(done) if done is not None else None
    if registry is not None and hits is not None:
        ids = structures.sequence_ids(records, registry, config.name)
        best = structures.best_hits(hits, ids).persist(StorageLevel.MEMORY_AND_DISK)
        result.held.append(best)
        summary["targets"]["structures"] = {"similarity": [r.asDict() for r in structures.summary(best).collect()], "coverage": _first(structures.coverage(ids))}
        result.structure_alignments = structures.top_hits(best)
    return result
