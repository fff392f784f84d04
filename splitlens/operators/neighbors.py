"""Nearest neighbours by Tanimoto similarity of bit sets.

Equal sets are collapsed first and equal pairs are settled by a join. The rest is a block join: packed blocks of queries
meet packed blocks of references of like sizes first. Two sets are at most as similar as the smaller size by the larger; a
query whose best is at least what the next wider band could give is done, and only the others meet it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.operators import blocks
from splitlens.session import written

BANDS = (0.8, 0.5, 0.0)  # least similarity that sizes allow, band by band; the last one holds all


def _bests(queries: DataFrame, made: list[blocks.Block], packed: DataFrame, met: list[blocks.Block], n_bits: int, low: float, high: float) -> DataFrame:
    """``id`` and ``similarity`` of the best reference of blocks that can be ``low`` to (not) ``high`` alike."""
    spark = queries.sparkSession
    partners = []
    for q in made:
        fits = [r.no for r in met if low <= q.alike(r) < high]  # on both sides of what was met before
        runs, start = [], None
        for k, no in enumerate(fits):
            start = no if start is None else start
            if k + 1 == len(fits) or fits[k + 1] != no + 1:
                runs.append(range(start, no + 1))
                start = None
        partners.append((q.no, runs))
    kind = queries.schema["id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = blocks.Rows.of(left, n_bits), blocks.Rows.of(right, n_bits)
        best = np.zeros(len(a.ids))
        for at, both in blocks.products(a, b, n_bits):
            shared = both.astype(np.float64)
            either = a.sizes[:, None] + b.sizes[None, at : at + both.shape[1]] - shared
            none = either == 0
            np.divide(shared, np.maximum(either, 1, out=either), out=shared)
            shared[none] = 1.0
            best = np.maximum(best, shared.max(1, initial=0.0))
        return pa.table({"id": a.ids, "similarity": pa.array(best)})

    own = blocks.packed(queries, made, n_bits)
    found = blocks.meet(own, packed, blocks.cells_of(spark, partners), compare, f"id {kind}, similarity double")
    return found.groupBy("id").agg(F.max("similarity").alias("similarity"))


def nearest(queries: DataFrame, reference: DataFrame, n_bits: int) -> DataFrame:
    """For every row of ``queries`` that has ``bits``: all its columns and ``similarity``, the largest to any row of
    ``reference`` that has ``bits``; no rows if there is none. ``n_bits`` is a hint, larger elements are right, too."""
    spark = queries.sparkSession
    key = F.md5(F.array_join("bits", ","))
    sets = lambda df: df.where("bits is not null").select(F.array_distinct(F.array_sort("bits")).alias("bits")).distinct().select(key.alias("id"), "bits", F.size("bits").alias("size"))
    refs, asked = written(sets(reference), "references"), queries.where("bits is not null")
    each = sets(asked)
    found = [each.join(refs, "id", "left_semi").select("id", F.lit(1.0).alias("similarity"))]
    left = written(each.join(refs, "id", "left_anti"), "queries")
    sizes, domain = blocks.histogram(refs)
    tasks = spark.sparkContext.defaultParallelism
    if sizes:
        n_bits = max(n_bits, domain, blocks.histogram(left)[1])
        met = blocks.blocks_of(sizes, n_bits, tasks)
        packed, high = written(blocks.packed(refs, met, n_bits), "packed-references"), 2.0
        made = blocks.blocks_of(blocks.histogram(left)[0], n_bits, tasks)  # the same for all bands: a query stays in its block
        for low in BANDS:
            if left.isEmpty():
                break
            best = written(_bests(left, made, packed, met, n_bits, low, high), "neighbours")
            found.append(best)
            if low:
                left = written(left.join(best.where(F.col("similarity") >= low), "id", "left_anti"), "queries")
            high = low
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    best = every.groupBy("id").agg(F.max("similarity").alias("similarity")).withColumnRenamed("id", "__id")
    named = asked.withColumn("__own", F.md5(F.array_join(F.array_distinct(F.array_sort("bits")), ",")))
    return named.join(best, F.col("__own") == F.col("__id")).drop("__own", "__id")


def nearest_summary(queries: DataFrame, reference: DataFrame, n_bits: int) -> DataFrame:
    """Mean, population deviation and number of query rows; nulls and 0 where there is nothing to compare."""
    return nearest(queries, reference, n_bits).agg(F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("std"), F.count("similarity").alias("n"))
