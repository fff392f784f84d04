"""Counts and statistics of splits: each needs one grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.functions.labels import SPLIT_BITS, split_bit



def in_tv() -> Column:
    return F.col("split").isin("train", "valid")


def split_counts(records: DataFrame) -> DataFrame:
    """Rows by split; ``valid`` is null where there is none."""
    n = {s: F.count(F.when(F.col("split") == s, 1)) for s in SPLIT_BITS}
    return records.agg(n["train"].alias("train"), F.when(n["valid"] > 0, n["valid"]).alias("valid"), n["test"].alias("test"))


def presence(records: DataFrame, *keys: str) -> DataFrame:
    """One row per key value (null is one): ``mask`` of the splits that have it, and ``n`` rows by split."""
    by_split = [F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in SPLIT_BITS]
    return records.groupBy(*keys).agg(F.bit_or(split_bit(F.col("split"))).alias("mask"), *by_split)


def overlap(records: DataFrame, key: str) -> DataFrame:
    """Unique and shared values of ``key``, rows, and duplicates by split, from one presence table.

    ``unique`` and ``shared`` count values; a null key counts as a value in totals only."""
    p = presence(records, key)
    known = F.col(key).isNotNull()

    def has(bits: int) -> Column:
        return F.col("mask").bitwiseAND(bits) != 0

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    out = {f"unique_{s}": n(known & has(b)) for s, b in SPLIT_BITS.items()}
    out |= {
        "shared_train_valid": n(known & has(1) & has(2)),
        "shared_train_test": n(known & has(1) & has(4)),
        "shared_valid_test": n(known & has(2) & has(4)),
        "shared_tv_test": n(has(3) & has(4)),
        "n_rows": F.coalesce(F.sum(F.col("n_train") + F.col("n_valid") + F.col("n_test")), F.lit(0)),
        "n_unique": n(has(7)),
    }
    out |= {f"duplicates_{s}": F.coalesce(F.sum(F.col(f"n_{s}")), F.lit(0)) - n(known & has(b)) for s, b in SPLIT_BITS.items()}
    out["n_duplicates"] = out["n_rows"] - out["n_unique"]
    return p.agg(*[c.cast("long").alias(k) for k, c in out.items()])


def warning_stats(records: DataFrame, column: str = "n_warnings") -> DataFrame:
    """Mean and sample deviation of warnings over train and valid; a null is none; 0.0 where not defined."""
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0)) if column in records.columns else F.lit(0.0)
    return records.where(in_tv()).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def label_stats(records: DataFrame) -> DataFrame:
    """By label position over train and valid: ``pos``, ``n``, ``mean``, sample ``std``; missing values don't count."""
    each = records.where(in_tv()).select(F.posexplode("label_num").alias("pos", "x"))
    return each.groupBy("pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def three_sigma(records: DataFrame) -> list[float]:
    """Three sample deviations by label position, 0.0 where fewer than two numbers are; as many as positions."""
    rows = {r.pos: r.std for r in label_stats(records).collect()}  # a row per label position
    return [3.0 * (rows.get(i) or 0.0) for i in range(max(rows, default=0) + 1)]


def population_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation and count of a column."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("n"))


def fraction_summary(points: DataFrame, fraction: str, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric by noise fraction."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return points.groupBy(fraction).agg(*aggs, F.count(F.lit(1)).alias("n_points"))
