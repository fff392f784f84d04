"""Contamination of records that arrive on a stream: against a fixed reference, or between the splits of the stream itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from splitlens.functions.labels import split_bit


def files(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """A stream of the Parquet files of a folder, or of a single file."""
    known, path = spark.read.parquet(path), path.rstrip("/")
    if [f.rsplit("/", 1)[-1] for f in known.inputFiles()] == [path.rsplit("/", 1)[-1]]:
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a pattern; this one fits the single file
    return spark.readStream.schema(known.schema).options(**options).parquet(path)


def contaminated(stream: DataFrame, reference: DataFrame, key: str = "entity") -> DataFrame:
    """Rows of ``stream`` whose key is in ``reference``: a stream-static semi join, without state."""
    return stream.join(reference.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def contamination_counts(stream: DataFrame, reference: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour", key: str = "entity") -> DataFrame:
    """By window of event time: rows, and rows whose key is in the reference; rows later than ``late`` are dropped."""
    known = reference.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__known", F.lit(1))
    tagged = stream.withWatermark(time, late).join(known, key, "left")
    return tagged.groupBy(F.window(time, window).alias("window")).agg(F.count(F.lit(1)).alias("n"), F.count("__known").alias("n_contaminated"))


def _both(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's splits so far are its state. It is emitted when train or valid and test have come together."""
    before = state.get[0] if state.exists else 0
    mask = before
    for batch in batches:
        for bit in batch["bit"].unique():
            mask |= int(bit)
    if mask != before:
        state.update((mask,))
    whole = lambda m: bool(m & 3) and bool(m & 4)
    if whole(mask) and not whole(before):
        yield pd.DataFrame({"key": [key[0]], "mask": pd.array([mask], "int32")})


def newly_contaminated(stream: DataFrame, key: str = "entity") -> DataFrame:
    """``key`` (its SHA-256) and ``mask`` of splits, once for each key that is both in train or valid and in test, as soon as
    it is: records may come in any order and any batches. The state is four bytes a key and has to be kept as long as
    records come. Null keys are no key. Write it in append mode."""
    marks = stream.where(F.col(key).isNotNull()).select(F.sha2(F.col(key).cast("string"), 256).alias("key"), split_bit(F.col("split")).alias("bit"))
    return marks.groupBy("key").applyInPandasWithState(_both, "key string, mask int", "mask int", "append", GroupStateTimeout.NoTimeout)
