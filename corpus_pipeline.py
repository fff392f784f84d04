"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, whole, and its decisions take effect; all but the last return the
columns of ``documents``. A stage's result is written before the next begins, which then deletes the tables that its
predecessor kept on the way. Rows without id pass the stages that compare ids unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlens.llm import decontamination, language_id, line_dedup, packing, partenum
from splitlens.llm.common import begin_stage, flat, place, saved, stage_tables
from splitlens.llm.queries import table, vocabulary


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go; where no row has a label, none can be judged and all stay. The text model learns
    from a bounded sample of labelled rows; the label itself is no evidence of its own row."""
    with stage_tables(spark):
        return language_id.accepted(docs, language_id.fit(docs), host="source")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go; a document goes with its last line of words. ``n_chars`` follows the text."""
    with stage_tables(spark):
        kept = line_dedup.dedup_lines(docs, drop_emptied=True)
    rows, removed, at = flat(kept), f"c{len(docs.columns) + 1}", place(docs, "n_chars")
    n_chars = F.when(F.col(removed) > 0, F.length(place(docs, "text")).cast(docs.schema[int(at[1:])].dataType)).otherwise(F.col(at))
    return rows.withColumn(at, n_chars).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    with stage_tables(spark):
        return partenum.one_of_each(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    with stage_tables(spark):
        return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its ids and its place in a sequence."""
    begin_stage(spark)
    return packing.packed(docs, vocabulary(), end_id=0)


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_benchmark_documents),
    ("packing", pack_sequences),
]

#: SQL does not express the text model and the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
