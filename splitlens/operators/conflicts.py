"""Entities whose labels disagree, within a split or across splits.

No rows are paired. For classification one aggregation by (entity, label) gives the splits of each label, and a
second by entity counts labels by split set: two splits conflict on an entity that both have and that has more
than one label in them together. For regression, the largest difference within or across splits follows from
each split's extremes. Records of classes are dealt by key first; a hot entity is one task's, which holds a row for each of
its labels. Numbers hold a hot entity as one combined row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.functions.labels import SPLIT_BITS, split_bit

PART_ROWS = 500_000

#: Kind of conflict and the split sets that it compares.
KINDS = {
    "intra_train": (1, 1),
    "intra_valid": (2, 2),
    "intra_test": (4, 4),
    "cross_train_valid": (1, 2),
    "cross_train_test": (1, 4),
    "cross_valid_test": (2, 4),
    "severe_trainvalid_test": (3, 4),
}


def _kinds(tests: dict[str, Column], key: list[str]) -> Column:
    """Names of the kinds that hold. Within a split, records without key are no group; across splits, they match."""
    named = F.lit(True)
    for k in key:
        named = named & F.col(k).isNotNull()
    found = [F.when(test & (named if kind.startswith("intra") else F.lit(True)), F.lit(kind)) for kind, test in tests.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _by_key(records: DataFrame, key: list[str]) -> DataFrame:
    """``records`` dealt by key into parts of about ``PART_ROWS``. Aggregations by key follow where the rows are: keys that are
    nearly all different would fill a task's memory by its share of the input, as large as that may be, only to be dealt after that."""
    n = records.count()
    return records.repartition(max(records.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS)), *key)


def classification_conflicts(records: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Key columns and ``kinds`` of each entity in conflict. Missing labels equal each other and nothing else."""
    key = key or ["entity"]
    records = _by_key(records.select(*key, "label_key", "split"), key)
    labels = records.groupBy(*key, "label_key").agg(F.bit_or(split_bit(F.col("split"))).alias("mask"))
    sets = {b for pair in KINDS.values() for b in (*pair, pair[0] | pair[1])}
    n = {b: F.count(F.when(F.col("mask").bitwiseAND(b) != 0, 1)).alias(f"n{b}") for b in sorted(sets)}
    found = labels.groupBy(*key).agg(*n.values())
    tests = {kind: (F.col(f"n{a}") > 0) & (F.col(f"n{b}") > 0) & (F.col(f"n{a | b}") > 1) for kind, (a, b) in KINDS.items()}
    return found.select(*key, _kinds(tests, key).alias("kinds")).where(F.size("kinds") > 0)


def regression_conflicts(records: DataFrame, sigma3: list[float], key: list[str] | None = None) -> DataFrame:
    """The same where numbers differ by three deviations or more at any position; a zero threshold is off."""
    key = key or ["entity"]
    each = records.select(*key, "split", F.posexplode("label_num").alias("pos", "x")).where("x is not null")
    at = F.least(F.col("pos"), F.lit(len(sigma3) - 1))
    each = each.withColumn("limit", F.get(F.array(*[F.lit(float(s)) for s in sigma3]), at)).where("limit != 0")
    ends = [a for s in SPLIT_BITS for a in (F.min(F.when(F.col("split") == s, F.col("x"))).alias(f"lo_{s}"), F.max(F.when(F.col("split") == s, F.col("x"))).alias(f"hi_{s}"))]
    by_place = each.groupBy(*key, "pos", "limit").agg(*ends)

    def end(which: str, bits: int) -> Column:
        own = [F.col(f"{which}_{s}") for s, b in SPLIT_BITS.items() if b & bits]
        return own[0] if len(own) == 1 else (F.least(*own) if which == "lo" else F.greatest(*own))

    def apart(a: int, b: int) -> Column:
        return F.coalesce(F.greatest(end("hi", a) - end("lo", b), end("hi", b) - end("lo", a)) >= F.col("limit"), F.lit(False))

    tests = {kind: F.bool_or(apart(a, b)).alias(kind) for kind, (a, b) in KINDS.items()}
    found = by_place.groupBy(*key).agg(*tests.values())
    return found.select(*key, _kinds({k: F.col(k) for k in KINDS}, key).alias("kinds")).where(F.size("kinds") > 0)


def conflict_counts(conflicts: DataFrame) -> DataFrame:
    """Entities in conflict by kind, one column each."""
    return conflicts.agg(*[F.count(F.when(F.array_contains("kinds", k), 1)).alias(k) for k in KINDS])


def conflict_rows(records: DataFrame, conflicts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Records of the entities in conflict, once for each kind whose splits hold the record."""
    key = key or ["entity"]
    found = conflicts.select(*[F.col(k).alias(f"__{k}") for k in key], "kinds")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    joined = records.join(found, same).select(*records.columns, F.explode("kinds").alias("kind"))
    mask = F.lit(0)
    for kind, (a, b) in KINDS.items():
        mask = F.when(F.col("kind") == kind, a | b).otherwise(mask)
    return joined.where(mask.bitwiseAND(split_bit(F.col("split"))) != 0)
