"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Every ``n``
consecutive words of a test item are a window; an item of fewer words, but not none, is one window.
Each document is scanned once, whole, in the partition it lies in: rolling fingerprints of its
windows are looked up in the set, hits are verified word by word, and hit words are merged to spans.
No shuffle.

The set is built once, on the driver, and broadcast as sorted arrays in blocks of at most ``block_bytes`` of test text, a
documented bound (the arrays take some five times as much). Up to ``MOST_BLOCKS`` blocks are narrow passes over the same
partitions; a benchmark that needs more is met by joins (``ngram_join``), with the same results. Only an item that is longer
than a block by itself exceeds it.

Defined results: a null or empty text has no words and no hits; a null or wordless item has no
window; repeated items are items of their own, and ids are reported once; an item without id counts
as a hit but is not listed; repeated rows are judged alike; an empty benchmark hits nothing; other
columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import chosen, column, flat, lean, place
from splitlens.llm.ngram_join import SPAN_TYPE, joined, runs
from splitlens.llm.textscan import LOWER, NOT_ALNUM, Spans, scan

WINDOW = 10
BLOCK_BYTES, MOST_BLOCKS = 4 << 20, 4
SPANS, ITEMS, WORDS, HITS = "__hit_spans", "__hit_items", "__hit_words", "__n_hits"


class Windows:
    """Different windows of one length, by fingerprint: a word that each begins with, and the items that have it."""

    def __init__(self, words: NgramSet, hashes: np.ndarray, first: np.ndarray, item: np.ndarray, size: int):
        order = np.argsort(hashes, kind="stable")
        hashes, first, item = hashes[order], first[order], item[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        for i in np.flatnonzero(~new).tolist():  # other words under the same fingerprint are a window of their own
            new[i] = words.text(first[i], size) != words.text(first[i - 1], size)
        at = np.flatnonzero(new)
        self.hashes, self.first, self.item, self.ends = hashes[at], first[at], item, np.append(at[1:], len(hashes))
        self.begins = at
        self.shift = np.uint64(64 - min(22, max(8, len(at).bit_length() + 4)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[hashes >> self.shift] = True


class NgramSet:
    """Windows of one block of test items, by length, with their words for verification."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        self.ids = [i for i, _ in items]
        data, starts, ends, found, at, words = [], [], [], {}, 0, 0
        for s in scan(pa.array([text for _, text in items], pa.string()), NOT_ALNUM, LOWER):
            spans, counts = Spans(s.hashes), np.diff(s.bounds)
            data.append(LOWER[s.data])
            starts.append(s.starts + at)
            ends.append(s.ends + at)
            for size in np.unique(np.minimum(counts, n)).tolist():
                of = np.flatnonzero(np.minimum(counts, n) == size) if size else np.zeros(0, np.int64)
                if len(of):
                    each = counts[of] - size + 1
                    first = np.repeat(s.bounds[of] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    found.setdefault(size, []).append((spans(first, first + size), first + words, np.repeat(of + s.row, each)))
            at, words = at + len(s.data), words + len(s.starts)
        self.data, self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (data, starts, ends))
        self.lengths = {size: Windows(self, *(np.concatenate(x) for x in zip(*parts, strict=True)), size) for size, parts in found.items()}

    def text(self, first: int, size: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[first : first + size].tolist(), self.ends[first : first + size].tolist(), strict=True))

    def hits(self, s) -> Iterator[tuple[int, int, list]]:
        """(first word, words, item ids) of each verified window of a slice."""
        if not len(s.hashes):
            return
        spans, doc_end, folded = Spans(s.hashes), np.repeat(s.bounds[1:], np.diff(s.bounds)), None
        for size, known in self.lengths.items():
            first = np.arange(len(s.hashes) - size + 1)
            if not len(first):
                continue
            first = first[first + size <= doc_end[: len(first)]]
            h = spans(first, first + size)
            near = known.seen[h >> known.shift]
            first, h = first[near], h[near]
            lo, hi = np.searchsorted(known.hashes, h, "left"), np.searchsorted(known.hashes, h, "right")
            same = np.flatnonzero(lo < hi)
            for i, a, b in zip(first[same].tolist(), lo[same].tolist(), hi[same].tolist(), strict=True):
                folded = LOWER[s.data] if folded is None else folded
                own = window_words(folded, s, i, size)
                for w in range(a, b):
                    if self.text(known.first[w], size) == own:
                        yield i, size, [self.ids[x] for x in known.item[known.begins[w] : known.ends[w]].tolist()]


def window_words(folded: np.ndarray, s, first: int, size: int) -> bytes:
    return b" ".join(folded[a:b].tobytes() for a, b in zip(s.starts[first : first + size].tolist(), s.ends[first : first + size].tolist(), strict=True))


def _scan_batch(batch: pa.RecordBatch, text_col: str, grams: NgramSet) -> pa.RecordBatch:
    old_spans, old_items = column(batch, "spans"), column(batch, "items")
    n = batch.num_rows
    spans, items, words, hits = [[]] * n, [[]] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s in scan(column(batch, text_col), NOT_ALNUM, LOWER):
        words[s.row : s.row + len(s)] = np.diff(s.bounds)
        delta, touched = None, {}
        for first, size, ids in grams.hits(s):
            if delta is None:
                delta = np.zeros(len(s.hashes) + 1, np.int64)
            delta[first] += 1
            delta[first + size] -= 1
            touched.setdefault(int(np.searchsorted(s.bounds, first, "right")) - 1, set()).update(ids)
        inside = None if delta is None else np.cumsum(delta) > 0  # over the whole slice: what ends with a document is taken off in the next one's first word
        for d in range(len(s)):
            before = old_spans[s.row + d].as_py() if old_spans is not None else []
            if d not in touched and not before:
                continue
            lo, hi = int(s.bounds[d]), int(s.bounds[d + 1])
            covered = np.zeros(hi - lo, bool)
            if inside is not None:
                covered |= inside[lo:hi]
            for x in before:
                covered[x["first"] : x["end"]] = True
            a, b = runs(covered)
            spans[s.row + d] = [{"first": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            ids = touched.get(d, set()) | set(old_items[s.row + d].as_py() if before else ())
            items[s.row + d] = sorted(x for x in ids if x is not None)
            hits[s.row + d] = int(covered.sum())
    new = {"spans": pa.array(spans, SPAN_TYPE), "items": pa.array(items, pa.list_(pa.int64())), "words": pa.array(words), "hits": pa.array(hits)}
    return pa.RecordBatch.from_arrays([new.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], names=batch.schema.names)


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id_col: str, item_text_col: str, n: int, block_bytes: int) -> DataFrame:
    """``flat`` documents and ``spans``, ``items``, ``words`` and ``hits``."""
    spark, text = docs.sparkSession, place(docs, text_col)
    test = chosen(benchmark, i=item_id_col, t=item_text_col).select(F.col("i").cast("long").alias("i"), "t").distinct()
    size = test.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(2 * size / block_bytes)) if size > block_bytes else 1
    if blocks > MOST_BLOCKS:
        return joined(flat(docs), text, test, n)
    out = flat(docs).select("*", F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"), F.array().cast("array<bigint>").alias("items"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("hits"))
    for k in range(blocks):
        own = test if blocks == 1 else test.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        rows = [(r.i, r.t) for r in own.collect()]  # at most block_bytes of test text, on average half
        shared = spark.sparkContext.broadcast(NgramSet(rows, n))

        def look_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _scan_batch(batch, text, shared.value)

        out = out.mapInArrow(lean(look_up), out.schema)
    return out


def hit_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` and then ``__hit_spans`` (word spans), ``__hit_items`` (ids), ``__hit_words``
    (words in the text) and ``__n_hits`` (words hit)."""
    return _found(docs, benchmark, text_col, item_id_col, item_text_col, n, block_bytes).toDF(*docs.columns, SPANS, ITEMS, WORDS, HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without hit documents (mode ``documents``), or with hit words cut out (mode ``spans``:
    kept words as they stand, the separators before a removed word go with it). Columns stay as they are."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    found, own = _found(docs, benchmark, text_col, item_id_col, item_text_col, n, block_bytes), flat(docs)
    if mode == "documents":
        return found.where("hits = 0").select(*own.columns).toDF(*docs.columns)
    text = place(docs, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = column(batch, "hits").to_numpy(zero_copy_only=False)
            whole = column(batch, text)
            texts = whole.to_pylist()
            for i in np.flatnonzero(hits).tolist():
                s = next(scan(whole.slice(i, 1), NOT_ALNUM, LOWER))
                out, last = [], 0
                for x in column(batch, "spans")[i].as_py():
                    out.append(s.data[last : s.ends[x["first"] - 1] if x["first"] else 0].tobytes())
                    last = int(s.ends[x["end"] - 1])
                texts[i] = b"".join([*out, s.data[last:].tobytes()]).decode()
            names = [c for c in batch.schema.names if c not in ("spans", "items", "words", "hits")]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else column(batch, c) for c in names], names=names)

    return found.mapInArrow(cut, own.schema).toDF(*docs.columns)
