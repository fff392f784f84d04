"""Metrics of predictions, as aggregations over (``y``, ``score``)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlens.session import written

STEPS = 250_000  # of the curve, that one task sums


def _by_score(df: DataFrame) -> DataFrame:
    """Positives and negatives by score, with those of higher or equal scores: ties are one step of the curve.

    A prefix sum on two levels: distinct scores are cut into ranges of about ``STEPS``, as many as their number asks for; sums run
    within a range, and what the ranges above hold, a row each, is added. Where the cuts lie does not change the result."""
    known = df.where("y is not null and score is not null")
    counted = known.groupBy("score").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("n"))
    counted = written(counted, "steps")
    parts = max(1, math.ceil(counted.count() / STEPS))
    steps = written(counted.repartitionByRange(parts, F.desc("score")).withColumn("part", F.spark_partition_id()), "ranges") if parts > 1 else counted.withColumn("part", F.lit(0))
    sums = steps.groupBy("part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    table = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_above") for c in ("p", "n")])
    above = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = steps.withColumn("tp", F.sum("p").over(above)).withColumn("fp", F.sum("n").over(above)).join(F.broadcast(table), "part")
    return summed.withColumn("tp", F.col("tp") + F.col("p_above")).withColumn("fp", F.col("fp") + F.col("n_above"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve by mid-ranks; null unless both classes occur."""
    s = _by_score(df)
    wins = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2))
    return s.agg((wins / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("roc_auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall; null without positives."""
    s = _by_score(df)
    return s.agg((F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def regression_metrics(df: DataFrame) -> DataFrame:
    known = df.where("y is not null and score is not null")
    return known.agg(F.avg(F.pow(F.col("y") - F.col("score"), 2)).alias("mse"), F.corr("y", "score").alias("pearson"))
