"""Structure search hits: the best one per query, coverage, and the list of the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comparisons in their order: query splits, reference splits, names.
COMPARISONS = [(("valid",), ("train",), "valid", "train"), (("test",), ("train",), "test", "train"), (("test",), ("train", "valid"), "test", "train_valid")]


def sequence_ids(records: DataFrame, registry: DataFrame, dataset: str | None = None) -> DataFrame:
    """``sequence_id`` of each target in the records, with the splits that have it. Of several ids of a sequence, the
    first in the registry counts; with ``dataset``, only sources of it."""
    known = registry.withColumn("line", F.monotonically_increasing_id()) if "line" not in registry.columns else registry
    if dataset is not None:
        known = known.where(F.exists("sources", lambda s: s["dataset"] == dataset))
    first = known.groupBy("sequence").agg(F.min_by("sequence_id", "line").alias("sequence_id"))
    own = records.where("target_seq != ''").select("target_seq", "split").distinct()
    return own.join(first, own["target_seq"] == first["sequence"]).groupBy("sequence_id", "sequence").agg(F.collect_set("split").alias("splits"))


def best_hits(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Best hit of each query by comparison: highest probability, then score, then first in the file; of lines with one number
    the largest by all columns in their order. One scan: the sides of query and target are joined once and decide which
    comparisons a hit counts for."""
    side = lambda n: ids.select(F.col("sequence_id").alias(n), F.col("splits").alias(f"splits_{n}"), F.col("sequence").alias(f"seq_{n}"))
    both = hits.join(side("query"), "query").join(side("target"), "target")
    counts = [
        F.when(F.arrays_overlap("splits_query", F.array(*[F.lit(s) for s in q])) & F.arrays_overlap("splits_target", F.array(*[F.lit(s) for s in r])), F.struct(F.lit(i).alias("no"), F.lit(qn).alias("split_query"), F.lit(rn).alias("split_reference")))
        for i, (q, r, qn, rn) in enumerate(COMPARISONS)
    ]
    each = both.withColumn("c", F.explode(F.filter(F.array(*counts), lambda x: x.isNotNull())))
    own = F.struct(*[c for c in (*hits.columns, "seq_query", "seq_target")])
    rank = F.struct(F.col("probability"), F.col("score"), (-F.col("line")).alias("line"), own)
    best = each.groupBy("c", "query").agg(F.max_by(own, rank).alias("hit"))
    return best.select("c.*", "hit.*")


def summary(best: DataFrame) -> DataFrame:
    """By comparison: queries, and mean and population deviation of probability, score and E-value. Self hits count."""
    stats = [a for c in ("probability", "score", "evalue") for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return best.groupBy("no", "split_query", "split_reference").agg(F.count(F.lit(1)).alias("n"), *stats)


def top_hits(best: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best by probability and score, then by comparison and query, without pairs of equal sequences."""
    other = best.where(F.coalesce(F.col("seq_query") != F.col("seq_target"), F.lit(True)))
    return other.orderBy(F.desc("probability"), F.desc("score"), "no", "query", "target").limit(k)


def coverage(ids: DataFrame) -> DataFrame:
    """Found sequence ids by split, and in train or valid."""
    has = lambda *s: F.count(F.when(F.arrays_overlap("splits", F.array(*[F.lit(x) for x in s])), 1))
    return ids.agg(has("train").alias("train"), has("valid").alias("valid"), has("test").alias("test"), has("train", "valid").alias("train_valid"))
