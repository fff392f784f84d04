"""Writers of audit results: small summaries by the driver, rows by Spark."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plain(value: Any) -> Any:
    """JSON-safe: rows and mappings to objects, sequences to lists, missing numbers to null, else text."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return str(value)


def _at(path: str | Path):
    """Hadoop's path and file system: any store that Spark writes to."""
    spark = SparkSession.active()
    there = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str | Path) -> bool:
    there, fs = _at(path)
    return fs.exists(there)


def _write(path: str | Path, content: bytes) -> None:
    there, fs = _at(path)
    out = fs.create(there, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_json(payload: Any, path: str | Path) -> Path:
    _write(path, json.dumps(plain(payload), indent=2).encode())
    return Path(path)


def _parts(fs, folder) -> list:
    return sorted((s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())


def _one_file(folder: str, to: str | Path, header: bool = False) -> Path:
    """Joins the part files of a folder, whatever their size, copied by the JVM; with ``header``, the first line of each
    but the first is left out."""
    there, fs = _at(folder)
    target, jvm = _at(to)[0], SparkSession.active()._jvm
    fs.delete(target, True)
    out = fs.create(target, True)
    try:
        for k, part in enumerate(_parts(fs, there)):
            own = fs.open(part.getPath())
            while header and k and own.read() not in (-1, 0x0A):
                pass
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 20, False)
            own.close()
    finally:
        out.close()
    fs.delete(there, True)
    return Path(to)


def write_rows(rows: DataFrame, path: str | Path, single: bool = True) -> Path | None:
    """An object per line; no file if there are no rows. ``single`` joins Spark's part files; else the path is a folder of them."""
    if not rows.head(1):
        return None
    folder = f"{path}.parts" if single else str(path)
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
    return _one_file(folder, path) if single else Path(path)


def write_records(records: DataFrame, path: str | Path, single: bool = True) -> Path | None:
    """CSV with a header; arrays as JSON; no file if there are no rows. ``single`` joins the part files under one header;
    else the path is a folder of parts, each with the header."""
    if not records.head(1):
        return None
    flat = records.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in records.dtypes])
    folder = f"{path}.parts" if single else str(path)
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)
    return _one_file(folder, path, True) if single else Path(path)


def write_fasta(sequences: DataFrame, path: str, id_col: str = "sequence_id", seq_col: str = "sequence") -> None:
    """A header and a sequence line each; rows without id or sequence are left out."""
    named = sequences.where((F.coalesce(F.col(id_col), F.lit("")) != "") & (F.coalesce(F.col(seq_col), F.lit("")) != ""))
    named.select(F.concat(F.lit(">"), id_col, F.lit("\n"), seq_col).alias("value")).write.mode("overwrite").text(path)


def write_sequences_csv(sequences: DataFrame, path: str, id_col: str = "sequence_id", seq_col: str = "sequence") -> None:
    named = sequences.where((F.coalesce(F.col(id_col), F.lit("")) != "") & (F.coalesce(F.col(seq_col), F.lit("")) != ""))
    named.select(F.col(id_col).alias("id"), F.col(seq_col).alias("sequence")).write.mode("overwrite").option("header", True).csv(path)


def fold_jobs(sequences: DataFrame, seeds: tuple[int, ...] = (1,)) -> DataFrame:
    """``name`` and ``value``: a structure prediction job for each sequence, as a JSON object."""
    chain = F.struct(F.struct(F.lit("A").alias("id"), F.col("sequence").alias("sequence")).alias("protein"))
    job = F.struct(F.col("sequence_id").alias("name"), F.array(*[F.lit(s) for s in seeds]).alias("modelSeeds"), F.array(chain).alias("sequences"), F.lit("alphafold3").alias("dialect"), F.lit(1).alias("version"))
    return sequences.select(F.col("sequence_id").alias("name"), F.to_json(job).alias("value"))


def write_fold_jobs(sequences: DataFrame, path: str, seeds: tuple[int, ...] = (1,)) -> None:
    """A folder ``name=...`` for each sequence with its job."""
    fold_jobs(sequences, seeds).write.mode("overwrite").partitionBy("name").text(path)


MANIFEST = "manifest.json"


def _bytes(path: str | Path) -> int | None:
    """Size of a file, or of the parts of a folder; None where there is nothing."""
    there, fs = _at(path)
    if not fs.exists(there):
        return None
    found = fs.getFileStatus(there)
    return sum(s.getLen() for s in _parts(fs, there)) if found.isDirectory() else found.getLen()


def write_manifest(folder: str | Path, names: Iterable[str]) -> None:
    """Written last: the files of a result and their sizes."""
    write_json({"files": {n: _bytes(f"{folder}/{n}") for n in sorted(names)}}, f"{folder}/{MANIFEST}")


def is_done(folder: str | Path, benchmark: bool = False) -> bool:
    """Whether a result is whole, so that it can be skipped: its manifest is there, and so is every file in it, rows as large as
    they were. A result that was cut off has no manifest, and one that lost a file or a part of its rows isn't whole; a summary
    may be edited."""
    if not exists(f"{folder}/{MANIFEST}"):
        return False
    lines = SparkSession.active().read.text(f"{folder}/{MANIFEST}", wholetext=True).first()
    try:
        files = json.loads(lines[0])["files"]
    except (TypeError, ValueError, KeyError):
        return False
    return "summary.json" in files and (not benchmark or "performance.json" in files) and all((found := _bytes(f"{folder}/{n}")) == size or (found is not None and n == "summary.json") for n, size in files.items())
