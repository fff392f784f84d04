"""Shared plumbing: tables in the cluster's shared folder, and Arrow helpers.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, which all executors
and the driver see, so that a lost executor costs a re-read and never a lost block.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a session in one process (tests) gets a folder of
    its own; a cluster has no folder that all executors see, which is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset; on {master or 'a cluster'} it has to name a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="splitlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def flat(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place, ``c0``, ``c1`` and so on: whatever the user calls columns, by case alone or
    like an operator's own, nothing clashes."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The name that ``flat`` gives to a column: of those that have the name, or else have it in other case, the first."""
    names = df.columns
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        if at := next((f"c{i}" for i, c in enumerate(names) if same(c)), None):
            return at
    raise ValueError(f"no column {name} among {', '.join(names)}")


def chosen(df: DataFrame, **columns: str) -> DataFrame:
    """Some columns of ``df`` under names of our own."""
    return flat(df).select(*[F.col(place(df, c)).alias(own) for own, c in columns.items()])


_scope = threading.local()


def begin_stage(spark: SparkSession) -> None:
    """For pipelines whose stages' results are written before the next begins: deletes the intermediate tables that
    the stage before noted in this thread. Only ``stage_tables`` notes any."""
    for path in getattr(_scope, "done", ()):
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    _scope.done = []


@contextlib.contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved within belong to one stage, whose result is written before the next stage begins. Outside,
    and after an error, nothing is noted: other queries in the thread keep theirs."""
    begin_stage(spark)
    _scope.paths = []
    try:
        yield
        _scope.done = _scope.paths
    finally:
        _scope.paths = None


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors. Unless ``keep``,
    a pipeline may delete the table when its next stage begins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep and getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files that no live plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_kept: list[Callable[[], None]] = []


def kept_by_worker(forget: Callable[[], None]) -> None:
    """Notes how to free what a Python worker keeps from task to task; ``lean`` tasks do so."""
    _kept.append(forget)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that first frees what other operators' tasks have left in the worker, and at its end gives
    free memory back to the system. Workers live longer than stages, and an executor's limit counts them all."""

    def leaner(batches: Iterator) -> Iterator:
        for forget in _kept:
            forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return leaner
