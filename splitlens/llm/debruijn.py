"""Substring dedup on a compacted De Bruijn graph of word windows.

The edges of the graph are the windows of ``window`` consecutive words. Neighbouring windows of a
document with one and the same minimizer, the least fingerprint among their ``ANCHOR``-word k-mers, are
one path (a super-k-mer): equal windows have equal minimizers, so whatever repeats meets at its
minimizer, and a minimizer seen in one document only needs no further look. Paths are joined by minimizer:

* where all occurrences of a minimizer carry one and the same path, the path does not branch. It is
  compact: its windows repeat together, and one comparison of ids decides all of them;
* where a minimizer has different paths, they branch. Their windows are taken apart, once for each
  different path, in the document with the smallest id that has it, and are joined one by one.

Each occurrence is kept by its coordinates (document, first word, number of windows), and each path by
its first source document. Identity is the agreement of two independent 64-bit fingerprints, of the
minimizer and of the whole span. Spans found for a document are merged and cut out in one pass.

What is shuffled per 50-word neighbourhood is one small row; texts are shuffled twice, by document.
A window, path or minimizer that fills a third of the table is combined before it is shuffled.

Defined results: a null text has no words; a row without id is kept whole and is no source; repeated
rows have the same id and are therefore judged alike, by other ids only; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import chosen, column, lean, release, saved
from splitlens.llm.textscan import WHITESPACE, Spans, scan, windows

WINDOW, ANCHOR = 50, 16
PATHS = "m long, path long, doc_id long, rk long, first int, n int"


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` consecutive values, by doubling."""
    out, size = x, 1
    while size < n:
        step = min(size, n - size)
        out, size = np.minimum(out[: len(out) - step], out[step:]), size + step
    return out


def _paths(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = column(batch, "doc_id").to_numpy(), column(batch, "rk").to_numpy()
            for s in scan(column(batch, "text"), WHITESPACE):
                first, doc = windows(s, window)
                if not len(first):
                    continue
                at = np.arange(len(s.hashes) - anchor + 1)
                least = sliding_min(Spans(s.hashes)(at, at + anchor), window - anchor + 1)[first]
                new = np.ones(len(first), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                start = np.flatnonzero(new)
                n = np.diff(np.append(start, len(first)))
                begin, row = first[start], s.row + doc[start]
                span = Spans(s.hashes, 1)(begin, begin + n - 1 + window)
                arrays = (least[start].view(np.int64), span.view(np.int64), ids[row], keys[row], (begin - s.bounds[doc[start]]).astype(np.int32), n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["m", "path", "doc_id", "rk", "first", "n"])

    return run


def _take_apart(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, asked = column(batch, "doc_id"), column(batch, "rk"), column(batch, "asked")
            for s in scan(column(batch, "text"), WHITESPACE):
                spans = Spans(s.hashes, 1)
                for d in range(len(s)):
                    r = s.row + d
                    own = asked[r].values
                    n = own.field("n").to_numpy()
                    p = np.repeat(own.field("first").to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())
                    at = p + s.bounds[d]
                    arrays = (np.repeat(own.field("m").to_numpy(), n), spans(at, at + window).view(np.int64), np.full(len(p), ids[r].as_py()), np.full(len(p), keys[r].as_py()), p.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["m", "w", "doc_id", "rk", "p"])

    return run


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id: ``doc_id``, ``rk`` (a fingerprint of
    the text), ``first`` word, ``n`` windows, ``source`` (the smallest such id)."""
    spark = docs.sparkSession
    own = _keyed(docs, id_col, text_col).where("doc_id is not null")
    paths = saved(own.mapInArrow(lean(_paths(window, anchor)), PATHS), "paths")
    meeting = saved(
        paths.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("path").alias("p0"), F.max("path").alias("p1")).where("lo < hi").select("m", (F.col("p0") != F.col("p1")).alias("branches")),
        "minimizers",
    )
    met = saved(paths.join(meeting, "m"), "met-paths")
    sources = saved(met.groupBy("m", "path").agg(F.min("doc_id").alias("source")), "sources")
    release(spark)
    traced = met.join(sources, ["m", "path"])
    whole = traced.where("doc_id > source").select("doc_id", "rk", "first", "n", "source")
    asked = traced.where("doc_id = source and branches").groupBy("doc_id", "rk").agg(F.collect_list(F.struct("m", "first", "n")).alias("asked"))
    apart = saved(own.join(asked, ["doc_id", "rk"]).mapInArrow(lean(_take_apart(window)), "m long, w long, doc_id long, rk long, p int"), "windows")
    release(spark)
    shared = apart.groupBy("m", "w").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("hi")).where("source < hi").drop("hi")
    single = apart.join(shared, ["m", "w"]).where("doc_id > source").select("doc_id", "rk", F.col("p").alias("first"), F.lit(1).alias("n"), "source")
    return whole.unionByName(single)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = chosen(docs, doc_id=id_col, text=text_col)
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("rk"))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``n_removed``, and ``kept``: its words outside of removed windows,
    joined by one space."""
    found = repeated_windows(docs, id_col=id_col, text_col=text_col, window=window, anchor=anchor)
    spans = found.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("first", "n")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            spans = column(batch, "spans")
            has = spans.is_valid().to_pylist()
            for i, text in enumerate(column(batch, "text").to_pylist()):
                words = text.encode().split() if text else []
                n_words.append(len(words))
                if has[i]:
                    own = spans[i].values
                    first, n = own.field("first").to_numpy(), own.field("n").to_numpy()
                    delta = np.bincount(first, minlength=len(words) + 1) - np.bincount(first + n - 1 + window, minlength=len(words) + 1)
                    words = list(compress(words, (np.cumsum(delta)[:-1] == 0).tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    texts = _keyed(docs, id_col, text_col)
    return texts.join(spans, ["doc_id", "rk"], "left").select("doc_id", "text", "spans").mapInArrow(lean(cut), "doc_id long, n_words long, n_removed long, kept string")
