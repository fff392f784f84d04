"""Connected components by alternating star contraction (Kiveris et al., 2014), on edge tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import saved


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """``edges`` with ``m``: the least ``v`` of each ``u`` or ``u`` itself. Combined before the shuffle, then joined
    back, so that a node with very many edges can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _least_neighbour(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    pair = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m"))))
    return down.select(pair.alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns ``u``, ``v``. Returns ``node`` and ``component`` (the least node that it reaches) for
    every node but the least of each component."""
    edges = saved(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        edges = saved(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
