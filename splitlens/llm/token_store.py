"""A content-addressed store of token ids.

A rolling hash over the last ``WINDOW`` ids cuts each document's ids into chunks where its content says
so, so equal passages give equal chunks wherever they stand. A chunk's address is the SHA-256 of its
bytes. The store has four tables, written by Spark in the shared folder:

* ``chunks/kind=chunk``: ``key`` (the address) and ``payload``: the ids, little-endian, two bytes each if
  all of them fit, else four, after one byte that says which. Each different chunk is stored once.
* ``recipes/kind=doc``: documents in ascending order of id, in files by range: ``doc_id``,
  ``local_start`` (ids before it in its range), ``n_tokens``, ``crc32``, the addresses ``chunks``, their
  ``sizes``, and ``root``, the Merkle root over the addresses.
* ``recipes/kind=part``: the manifest of each range: ids, documents, and the Merkle root over its documents.
* ``manifest``: one row: ranges, documents, ids, and the Merkle root over the ranges.

Chunks meet by address after a map-side combine; ids are shuffled once. ``start`` of a document is its
``local_start`` plus the ids of the ranges before it: one number for each range, which is all that the
driver gets. A reader checks every chunk against its address, every recipe against its root, every range against its
manifest and the ranges against the store's; it raises an error where a file is lost, altered or added.

``digests`` proves what a reader would rebuild without moving the ids again: the CRC of joined parts is a
sum (over GF(2)) of the parts' CRCs, each times a power of x, so a document's CRC is the ``bit_xor`` of
numbers that come from the chunk files. ``read_documents`` rebuilds the ids themselves.

Defined results: a null or empty text has the end id only; repeated rows and ids are stored each as a
recipe, ties in id in the order of size and CRC; a null id comes first; an empty table gives empty
tables; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlens.llm.common import chosen, column, shared_dir
from splitlens.llm.textscan import Spans, mix
from splitlens.llm.tokens import encoder

WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 1024
ROWS = "key binary, kind string, payload binary, doc_id long, n_tokens long, crc32 long, chunks array<binary>, sizes array<int>"
RECIPES = "kind string, part int, doc_id long, local_start long, n_tokens long, crc32 long, chunks array<binary>, sizes array<int>, root binary, n_docs long"
MANIFEST = "parts long, n_docs long, n_tokens long, root binary"
CRC_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, lowest bit first


def payload(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document: after a window whose hash is 0 modulo ``MEAN``, with ``LEAST``
    to ``MOST`` ids in a chunk (the last may be shorter)."""
    n, out, last = len(ids), [], 0
    if n > LEAST:
        first = np.arange(n - WINDOW + 1)
        marks = Spans(mix(ids.astype(np.uint64)))(first, first + WINDOW)
        ends = np.flatnonzero(marks % np.uint64(MEAN) == 0) + WINDOW
        for end in ends.tolist():
            while end - last > MOST:
                last += MOST
                out.append(last)
            if end - last >= LEAST:
                last = end
                out.append(last)
    while n - last > MOST:
        last += MOST
        out.append(last)
    return out + [n] * (n > last)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd one moves up. Leaves and nodes are hashed apart."""
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _chunked(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, count = encoder(tokenizer_path), TaskContext.get(), 0
        end = np.array([end_id], np.uint32)
        names = [x.split()[0] for x in ROWS.split(", ")]
        kinds = (pa.binary(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
        for batch in batches:
            of = column(batch, "__id").to_pylist()
            for s in encode.scan(column(batch, "__text")):
                rows, seen = [], set()
                for i in range(len(s.bounds) - 1):
                    ids = np.concatenate([s.ids[s.bounds[i] : s.bounds[i + 1]], end])
                    cuts = cut_points(ids)
                    keys = []
                    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
                        data = payload(ids[a:b])
                        keys.append(hashlib.sha256(data).digest())
                        if keys[-1] not in seen:
                            seen.add(keys[-1])
                            rows.append((keys[-1], "chunk", data, None, None, None, None, None))
                    name = b"doc" + (task.partitionId() if task else 0).to_bytes(8) + count.to_bytes(8)
                    count += 1
                    rows.append((name, "doc", None, of[s.row + i], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), keys, np.diff([0, *cuts]).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, in order: where each document starts, its root, and at last the manifest."""
    task = TaskContext.get()
    part, at, docs, roots = task.partitionId() if task else 0, 0, 0, []
    names = [x.split()[0] for x in RECIPES.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.int64())
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            rows.append(("doc", part, r["doc_id"], at, r["n_tokens"], r["crc32"], r["chunks"], r["sizes"], merkle_root(r["chunks"]), 1))
            at, docs = at + r["n_tokens"], docs + 1
            roots.append(rows[-1][-2])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(("part", part, None, None, at, None, None, None, merkle_root(roots), docs), kinds, strict=True)], names=names)


@dataclass
class Store:
    spark: SparkSession
    path: str

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/chunks").where("kind = 'chunk'").select("key", "payload")

    def recipes(self) -> DataFrame:
        """One row per document, with ``start``: the ids of all documents before it."""
        starts, at = [], 0
        for r in self.parts():
            starts.append((r.part, at))
            at += r.n_tokens
        before = self.spark.createDataFrame(starts, "part int, before long")
        return self._documents().join(F.broadcast(before), "part", "left").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "n_docs", "kind")

    def _documents(self) -> DataFrame:
        return self.spark.read.schema(RECIPES).parquet(f"{self.path}/recipes").where("kind = 'doc'")

    def parts(self) -> list:
        """The manifests of the ranges, a row for each, in order."""
        rows = self.spark.read.schema(RECIPES).parquet(f"{self.path}/recipes").where("kind = 'part'").select("part", "n_tokens", "root", "n_docs").collect()
        return sorted(rows, key=lambda r: r.part)

    def manifest(self) -> tuple:
        parts = self.parts()
        return len(parts), sum(r.n_docs for r in parts), sum(r.n_tokens for r in parts), merkle_root([bytes(r.root) for r in parts])

    def verify_recipes(self) -> None:
        """Ranges against the store's manifest, and each range's documents against its own."""
        parts = self.parts()
        n, docs, tokens, root = self.manifest()
        said = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()
        if len(said) != 1 or (said[0].parts, said[0].n_docs, said[0].n_tokens, bytes(said[0].root)) != (n, docs, tokens, root):
            raise ValueError(f"the ranges of {self.path} do not agree with its manifest")
        found = self._documents().select("part", "local_start", "n_tokens", "root").groupBy("part").applyInArrow(_range_root, "part int, docs long, tokens long, own binary")
        wanted = self.spark.createDataFrame([(r.part, r.n_docs, r.n_tokens, r.root) for r in parts], "part int, n_docs long, n_tokens long, root binary")
        same = F.col("docs").eqNullSafe(F.col("n_docs")) & F.col("tokens").eqNullSafe(F.col("n_tokens")) & F.col("own").eqNullSafe(F.col("root"))
        if wrong := found.join(wanted, "part", "full").where(~same).head(1):
            raise ValueError(f"the recipes of range {wrong[0].part} of {self.path} do not agree with its manifest")


def _range_root(table: pa.Table) -> pa.Table:
    table = table.sort_by("local_start")
    roots, tokens = table["root"].to_pylist(), table["n_tokens"].to_pylist()
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "docs": pa.array([len(roots)], pa.int64()), "tokens": pa.array([sum(tokens)], pa.int64()), "own": pa.array([merkle_root(roots)], pa.binary())})


def write(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None) -> Store:
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    own = chosen(docs, __id=id_col, __text=text_col)
    rows = own.select(F.col("__id").cast("long").alias("__id"), "__text").mapInArrow(_chunked(tokenizer_path, end_id), ROWS)
    fields = [x.split()[0] for x in ROWS.split(", ")][1:]
    once = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in fields])
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/chunks")
    found = spark.read.schema(ROWS).parquet(f"{path}/chunks").where("kind = 'doc'")
    ordered = found.select("key", "doc_id", "n_tokens", "crc32", "chunks", "sizes").repartitionByRange("doc_id", "n_tokens", "crc32", "key").sortWithinPartitions("doc_id", "n_tokens", "crc32", "key")
    ordered.mapInArrow(_in_order, RECIPES).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/recipes")
    store = Store(spark, path)
    spark.createDataFrame([store.manifest()], MANIFEST).write.parquet(f"{path}/manifest")
    return store


@lru_cache(maxsize=1)
def _shifts() -> list[int]:
    """x**(32 * 2**k) modulo the polynomial, for each k: what 2**k ids after a part do to its CRC."""
    x = 1 << 30  # x**1; the highest bit is x**0
    for _ in range(5):
        x = int(_times(np.array([x], np.uint64), x)[0])
    out = [x]
    for _ in range(47):
        out.append(int(_times(np.array([out[-1]], np.uint64), out[-1])[0]))
    return out


def _times(a: np.ndarray, by: int) -> np.ndarray:
    """Products of polynomials over GF(2), modulo the CRC's."""
    out, a = np.zeros_like(a), a.copy()
    for bit in range(31, -1, -1):
        if by >> bit & 1:
            out ^= a
        a = (a >> np.uint64(1)) ^ (np.uint64(CRC_POLYNOMIAL) * (a & np.uint64(1)))
    return out


def shifted_crc(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    out = crc.astype(np.uint64)
    for k, x in enumerate(_shifts()):
        own = (ids_after >> k & 1).astype(bool)
        if own.any():
            out[own] = _times(out[own], x)
        if not (ids_after >> k).any():
            break
    return out.astype(np.int64)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, crc = [], []
        keys = column(batch, "key").to_pylist()
        for key, data in zip(keys, column(batch, "payload").to_pylist(), strict=True):
            if hashlib.sha256(data).digest() != key:
                raise ValueError(f"chunk {key.hex()} does not hold what its address says")
            ids = ids_of(data)
            n.append(len(ids))
            crc.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["key", "n", "crc"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with the ids that follow it; recipes must agree with their roots."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for r in batch.to_pylist():
            if merkle_root(r["chunks"]) != r["root"]:
                raise ValueError(f"the recipe of document {r['doc_id']} does not agree with its root")
            after = r["n_tokens"] - np.cumsum(r["sizes"])
            for column_, values in zip(out, ([r["part"]] * len(after), [r["local_start"]] * len(after), r["chunks"], r["sizes"], after.tolist()), strict=True):
                column_.extend(values)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["part", "local_start", "key", "size", "after"])


def _shift_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, n = column(batch, "size"), column(batch, "n")
        if n.null_count or not n.equals(size):
            at = next(i for i in range(batch.num_rows) if n[i].as_py() != size[i].as_py())
            raise ValueError(f"chunk {column(batch, 'key')[at].as_py().hex()} is lost or is not of the size that a recipe gives")
        crc = shifted_crc(column(batch, "crc").to_numpy(), column(batch, "after").to_numpy())
        yield pa.RecordBatch.from_arrays([column(batch, "part"), column(batch, "local_start"), n, pa.array(crc, pa.int64())], names=["part", "local_start", "n", "crc"])


def _entries_of(recipes: DataFrame) -> DataFrame:
    return recipes.select("part", "local_start", "doc_id", "n_tokens", "chunks", "sizes", "root").mapInArrow(_entries, "part int, local_start long, key binary, size long, after long")


def digests(store: Store) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``. All files are checked; what
    the chunks add up to has to be what the recipe says."""
    store.verify_recipes()
    recipes = store.recipes()
    chunks = store.chunks().mapInArrow(_checked, "key binary, n long, crc long")
    parts = _entries_of(recipes).join(chunks, "key", "left").mapInArrow(_shift_batches, "part int, local_start long, n long, crc long")
    docs = parts.groupBy("part", "local_start").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("ids_crc32"))
    both = recipes.select("part", "local_start", "doc_id", "start", "n_tokens", "crc32").join(docs, ["part", "local_start"], "left")
    agree = F.col("n").eqNullSafe(F.col("n_tokens")) & F.col("ids_crc32").eqNullSafe(F.col("crc32"))
    wrong = F.raise_error(F.concat(F.lit("the chunks of a document are not what its recipe says: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return both.select("doc_id", "start", F.when(agree, F.col("n")).otherwise(wrong).cast("long").alias("n_tokens"), "ids_crc32")


def read_documents(store: Store) -> DataFrame:
    """Per document: ``doc_id``, ``start`` and ``ids`` (binary, little-endian uint32), rebuilt from chunks that
    agree with their addresses. A document's chunks meet in one row, as large as the document."""
    store.verify_recipes()

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                chunks = sorted(r["found"], key=lambda x: -x["after"])
                if any(x["payload"] is None or hashlib.sha256(x["payload"]).digest() != x["key"] for x in chunks):
                    raise ValueError(f"document {r['doc_id']} has a chunk that is lost or does not hold what its address says")
                ids = np.concatenate([ids_of(x["payload"]) for x in chunks])
                if zlib.crc32(ids.tobytes()) != r["crc32"]:
                    raise ValueError(f"document {r['doc_id']} does not agree with its recipe")
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "start"), pa.array(out, pa.binary())], names=["doc_id", "start", "ids"])

    recipes = store.recipes()
    found = _entries_of(recipes).join(store.chunks(), "key", "left").groupBy("part", "local_start").agg(F.collect_list(F.struct("after", "key", "payload")).alias("found"))
    docs = recipes.select("part", "local_start", "doc_id", "start", "crc32")
    return docs.join(found, ["part", "local_start"]).select("doc_id", "start", "crc32", "found").mapInArrow(rebuilt, "doc_id long, start long, ids binary")
