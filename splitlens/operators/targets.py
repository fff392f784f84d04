"""Target sequences across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.functions.labels import split_bit
from splitlens.operators.hygiene import presence



def cross_split_pairs(records: DataFrame) -> DataFrame:
    """(entity, target) pairs in more than one split, whatever their labels; ``mask`` of the splits."""
    return presence(records, "entity", "target_seq").where(F.bit_count("mask") > 1).select("entity", "target_seq", "mask")


def cross_split_pair_rows(records: DataFrame) -> DataFrame:
    pairs = cross_split_pairs(records).select(F.col("entity").alias("__entity"), F.col("target_seq").alias("__target"))
    same = F.col("entity").eqNullSafe(F.col("__entity")) & F.col("target_seq").eqNullSafe(F.col("__target"))
    return records.join(pairs, same, "left_semi").withColumn("kind", F.lit("pair_cross_split"))


def multi_entity_targets(records: DataFrame) -> DataFrame:
    """Targets in more than one split with more than one entity: ``n_entities``, ``mask`` and the first position."""
    order = F.struct(split_bit(F.col("split")).alias("split"), F.col("row_id").alias("row"))
    pairs = records.groupBy("target_seq", "entity").agg(F.bit_or(split_bit(F.col("split"))).alias("mask"), F.min(order).alias("first"))
    by_target = pairs.groupBy("target_seq").agg(F.count("entity").alias("n_entities"), F.bit_or("mask").alias("mask"), F.min("first").alias("first"))
    return by_target.where((F.bit_count("mask") > 1) & (F.col("n_entities") > 1))


def multi_entity_target_rows(records: DataFrame) -> DataFrame:
    found = multi_entity_targets(records).select("target_seq")
    return records.join(found, "target_seq", "left_semi").select(records.columns).withColumn("kind", F.lit("sequence_cross_split_multi_entity"))


def top_multi_entity_targets(records: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` targets with most entities; ties by first appearance, then by name."""
    return multi_entity_targets(records).orderBy(F.desc("n_entities"), "first", "target_seq").limit(k).select("target_seq", "n_entities", "mask")


def build_registry(sequences: DataFrame) -> DataFrame:
    """Columns ``order``, ``dataset``, ``split``, ``file``, ``sequence``. One row per normalized sequence that isn't
    empty: its id (12 hex digits of its SHA-1, ``@``, the dataset that has it first) and its sorted sources."""
    from splitlens.functions.labels import sequence

    named = sequences.withColumn("sequence", sequence(F.col("sequence"))).where("sequence != ''")
    source = F.struct("dataset", "split", "file")
    grouped = named.groupBy("sequence").agg(F.min_by("dataset", "order").alias("first"), F.array_sort(F.collect_set(source)).alias("sources"))
    return grouped.select(F.concat(F.substring(F.sha1("sequence"), 1, 12), F.lit("@"), "first").alias("sequence_id"), "sequence", "sources")
