"""Windows of test items that are too many to broadcast, found by joins.

A filter of fixed size (at most ``MOST_BITS`` bits, 32 MB, whatever the benchmark) is broadcast. Documents are scanned with it
where they lie; fingerprints of windows that pass go, once for each different text, to a shuffle by fingerprint, where test
windows that really occur meet them (salted by text: a passage of very many texts is spread). Found windows return, a row for
each text, to the documents that have it, which a second filter of the same kind picks; only those documents are shuffled
(salted by row: copies of one text are spread), and every hit is verified word by word in its document.

Defined results are those of the broadcast way: rows without words are clean, an item without id counts as a hit and is not
listed, repeated rows and items are judged alike, an empty side gives no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import column, lean, saved
from splitlens.llm.textscan import LOWER, NOT_ALNUM, Slice, Spans, scan

MOST_BITS, LEAST_BITS = 28, 16  # sizes of the filter, as powers of two
BUCKET = 4096  # bytes of one of Spark's bitmaps
SALTS = 16
SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
HASHABLE = ("string", "bigint", "int", "double", "float", "date", "timestamp")


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def spaced(s: Slice) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The folded words of a slice with one space behind each, and where each begins and ends."""
    lengths = s.ends - s.starts
    before = np.cumsum(lengths) - lengths
    at, letters = before + np.arange(len(lengths)), np.arange(lengths.sum())
    out = np.full(len(letters) + len(lengths), 0x20, np.uint8)
    out[np.repeat(at - before, lengths) + letters] = LOWER[s.data[np.repeat(s.starts - before, lengths) + letters]]
    return out.tobytes(), at, at + lengths


def places(s: Slice, size: int) -> np.ndarray:
    """The first word of every window of ``size`` words within one document."""
    doc = np.repeat(np.arange(len(s)), np.diff(s.bounds))
    return np.flatnonzero(np.arange(len(doc)) + size <= s.bounds[doc + 1])


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """Different windows of items (``i``, ``t``): fingerprint ``h``, ``size`` in words, ``words``, and the ``items`` that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "i")
            for s in scan(column(batch, "t"), NOT_ALNUM, LOWER):
                if not len(s.hashes):
                    continue
                spans, counts, (text, at, end) = Spans(s.hashes), np.diff(s.bounds), spaced(s)
                for size in np.unique(np.minimum(counts, n)).tolist():
                    if not size:
                        continue
                    first = places(s, size)
                    doc = np.searchsorted(s.bounds, first, "right") - 1
                    own = np.minimum(counts[doc], n) == size
                    first, doc = first[own], doc[own]
                    words = [text[a:b] for a, b in zip(at[first].tolist(), end[first + size - 1].tolist(), strict=True)]
                    of = [spans(first, first + size).view(np.int64), np.full(len(first), size, np.int32), pa.array(words, pa.binary()), ids.take(pa.array(s.row + doc))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in of], names=["h", "size", "words", "i"])

    return items.mapInArrow(lean(cut), "h long, size int, words binary, i long").groupBy("h", "size", "words").agg(F.collect_set("i").alias("items"))


class Filter:
    """One bit for each beginning of a fingerprint that occurs."""

    def __init__(self, rows: list, bits: int):
        self.shift, self.bytes = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)
        for r in rows:
            self.bytes[(r.bucket - 1) * BUCKET : r.bucket * BUCKET] = np.frombuffer(bytes(r.bitmap), np.uint8)

    def __call__(self, fingerprints: np.ndarray) -> np.ndarray:
        bit = fingerprints >> self.shift
        return (self.bytes[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def shared_filter(table: DataFrame, key: str) -> Broadcast:
    """A filter of a column's fingerprints, combined in the tasks; the driver gets bitmaps of ``MOST_BITS`` bits in all at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, table.count().bit_length() + 4))
    bit = F.shiftrightunsigned(key, 64 - bits) + 1
    found = table.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
    return table.sparkSession.sparkContext.broadcast(Filter(found.collect(), bits))


def joined(docs: DataFrame, text: str, items: DataFrame, n: int) -> DataFrame:
    """``docs`` (columns named by place) and ``spans``, ``items``, ``words`` and ``hits``; rows come in any order."""
    grams = saved(item_windows(items, n), "ngram-windows")
    sizes, passes = sorted(r.size for r in grams.select("size").distinct().collect()), shared_filter(grams, "h")
    keyed = docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [column(batch, k) for k in ("k1", "k2")]
            for s in scan(column(batch, text), NOT_ALNUM, LOWER):
                spans = Spans(s.hashes)
                for size in sizes:
                    first = places(s, size)
                    h = spans(first, first + size)
                    near = np.flatnonzero(passes.value(h))
                    doc = pa.array(s.row + np.searchsorted(s.bounds, first[near], "right") - 1)
                    yield pa.RecordBatch.from_arrays([*[k.take(doc) for k in keys], pa.array(h[near].view(np.int64))], names=["k1", "k2", "h"])

    seen = saved(keyed.select(text, "k1", "k2").mapInArrow(lean(candidates), "k1 long, k2 long, h long").distinct(), "ngram-candidates")
    occur = grams.join(seen.select("h").distinct(), "h", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = seen.withColumn("salt", F.pmod("k2", F.lit(SALTS)).cast("int")).join(occur, ["h", "salt"])
    hits = saved(met.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "size", "words", "items")).alias("found")), "ngram-hits")
    listed = shared_filter(hits, "k1")
    names = docs.columns

    def side(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = listed.value(column(batch, "k1").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(near if hit else ~near))

        return run

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = column(batch, "found") if "found" in batch.schema.names else pa.nulls(batch.num_rows)
            spans, owners, words, hit = [[]] * batch.num_rows, [[]] * batch.num_rows, np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for s in scan(column(batch, text), NOT_ALNUM, LOWER):
                words[s.row : s.row + len(s)] = np.diff(s.bounds)
                with_hits = [d for d in range(len(s)) if found[s.row + d].is_valid]
                if not with_hits:
                    continue
                fingers, (raw, at, end) = Spans(s.hashes), spaced(s)
                for d in with_hits:
                    lo, hi, of, known, covered = int(s.bounds[d]), int(s.bounds[d + 1]), set(), {}, np.zeros(int(s.bounds[d + 1] - s.bounds[d]), bool)
                    for g in found[s.row + d].as_py():
                        known.setdefault(g["size"], {}).setdefault(g["h"], []).append((g["words"], g["items"]))
                    for size, grams_of in known.items():
                        first = np.arange(lo, hi - size + 1)
                        h = fingers(first, first + size).view(np.int64)
                        for i in np.flatnonzero(np.isin(h, list(grams_of))).tolist():
                            own = raw[at[lo + i] : end[lo + i + size - 1]]
                            for same, ids in grams_of[int(h[i])]:
                                if same == own:
                                    covered[i : i + size] = True
                                    of.update(ids)
                    spans[s.row + d] = [{"first": x, "end": y} for x, y in zip(*(e.tolist() for e in runs(covered)), strict=True)]
                    owners[s.row + d], hit[s.row + d] = sorted(of), int(covered.sum())
            out = [*[column(batch, c) for c in names], pa.array(spans, SPAN_TYPE), pa.array(owners, pa.list_(pa.int64())), pa.array(words), pa.array(hit)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "spans", "items", "words", "hits"])

    none = {"spans": F.array().cast("array<struct<first:bigint,end:bigint>>"), "items": F.array().cast("array<bigint>"), "words": F.lit(0).cast("long"), "hits": F.lit(0).cast("long")}
    schema = docs.withColumns(none).schema
    salted = [c for c, kind in docs.dtypes if kind in HASHABLE]
    spread = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = keyed.mapInArrow(lean(side(True)), keyed.schema).withColumn("salt", F.pmod(F.xxhash64(*salted), F.lit(SALTS)).cast("int"))
    dirty = near.join(spread, ["k1", "k2", "salt"], "left").select(*names, "found").mapInArrow(lean(marked), schema)
    clean = keyed.mapInArrow(lean(side(False)), keyed.schema).mapInArrow(lean(marked), schema)
    return clean.unionByName(dirty)
