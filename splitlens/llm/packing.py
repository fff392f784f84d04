"""Hierarchical multi-length packing of token ids into sequences.

Every document (its ids and an end id) is cut into pieces, each piece is routed to the smallest
context-size tier that holds it, and each tier is packed, longest context first: a piece opens a
sequence of its tier; the gap is filled from the shorter tiers, the longest piece that fits first, and
closed exactly by cutting one more piece. Only the last sequences, for which no shorter piece is left,
have a gap: they move down to the smallest tier that holds their ids and are padded there. Sequences of
a tier are dealt to step groups, in turns from the costliest to the cheapest, so that the groups of
attention work (the sum of squared piece lengths) are even.

Documents are packed where they lie, a buffer of at most ``BUFFER_TOKENS`` ids at a time: nothing is
shuffled, no id leaves its partition, and a sequence id is the partition's number and a count.

Defined results: a null or empty text has the end id only; repeated rows are packed each for itself;
an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import chosen, column
from splitlens.llm.tokens import encoder

TIERS = (128, 256, 512, 1024)
GROUP = 8
BUFFER_TOKENS = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, padding int, step_group long"


class Shelf:
    """Pieces of one tier that are not packed yet, shortest first."""

    def __init__(self):
        self.pieces: list[tuple[int, int, int]] = []  # length, document, start

    def longest_within(self, most: int) -> tuple[int, int, int] | None:
        i = bisect_right(self.pieces, (most, 1 << 60, 0))
        return self.pieces.pop(i - 1) if i else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length); ``lengths`` are tokens by document."""
    largest = tiers[-1]
    shelves = [Shelf() for _ in tiers]
    tier_of = lambda n: next(i for i, t in enumerate(tiers) if n <= t)
    out: list[list[tuple[int, int, int]]] = []
    for doc, n in enumerate(lengths):
        full = n - n % largest
        out += [[(doc, at, largest)] for at in range(0, full, largest)]
        if n > full:
            shelves[tier_of(n - full)].pieces.append((n - full, doc, full))
    for shelf in shelves:
        shelf.pieces.sort()
    for i in range(len(tiers) - 1, -1, -1):
        while shelves[i].pieces:
            n, doc, start = shelves[i].pieces.pop()
            sequence, gap = [(doc, start, n)], tiers[i] - n
            while gap:
                piece = next((x for j in range(min(i, tier_of(gap)), -1, -1) if (x := shelves[j].longest_within(gap))), None)
                if piece is None:  # every piece left is longer than the gap: cut the shortest
                    j = next((j for j in range(i + 1) if shelves[j].pieces), None)
                    if j is None:
                        break
                    n, doc, start = shelves[j].pieces.pop(0)
                    insort(shelves[tier_of(n - gap)].pieces, (n - gap, doc, start + gap))
                    piece = (gap, doc, start)
                sequence.append((piece[1], piece[2], piece[0]))
                gap -= piece[0]
            out.append(sequence)
    return out


def balanced(costs: list[int], group: int) -> list[int]:
    """A step group for each sequence: dealt in turns, there and back, from the costliest."""
    groups = max(1, len(costs) // group)
    out = [0] * len(costs)
    for k, i in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        turn, place = divmod(k, groups)
        out[i] = place if turn % 2 == 0 else groups - 1 - place
    return out


def _packed(ids: list, texts: list[np.ndarray], tiers, group: int, base: int, group_base: int) -> tuple[pa.RecordBatch, int, int]:
    sequences = pack([len(x) for x in texts], tiers)
    totals = [sum(n for _, _, n in s) for s in sequences]
    tier = [next(t for t in (*(t for t in tiers if t < tiers[-1]), tiers[-1]) if n <= t) for n in totals]
    step = [0] * len(sequences)
    groups = 0
    for t in tiers:
        own = [i for i, x in enumerate(tier) if x == t]
        dealt = balanced([sum(n * n for _, _, n in sequences[i]) for i in own], group)
        for i, g in zip(own, dealt, strict=True):
            step[i] = groups + g
        groups += max(dealt, default=-1) + 1
    rows: list[tuple] = []
    for i, s in enumerate(sequences):
        at = 0
        for doc, start, n in s:
            rows.append((ids[doc], start, n, texts[doc][start : start + n].astype("<u4").tobytes(), len(texts[doc]), base + i, at, tier[i], tier[i] - totals[i], group_base + step[i]))
            at += n
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names), len(sequences), groups


def packed(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers: tuple[int, ...] = TIERS, group: int = GROUP) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` and ``length`` within its document, ``ids`` (binary,
    little-endian uint32), ``doc_tokens``, ``sequence_id``, ``offset`` within the sequence, the sequence's
    ``tier`` and ``padding`` up to it, and its ``step_group``."""
    if list(tiers) != sorted(set(tiers)) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers are ascending powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        task = TaskContext.get()
        base = group_base = (task.partitionId() if task else 0) << 40
        ids, texts, size = [], [], 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            of = column(batch, "__id").to_pylist()
            for s in encode.scan(column(batch, "__text")):
                for i in range(len(s.bounds) - 1):
                    ids.append(of[s.row + i])
                    texts.append(np.concatenate([s.ids[s.bounds[i] : s.bounds[i + 1]], end]))
                    size += len(texts[-1])
                if size >= BUFFER_TOKENS:
                    out, n, g = _packed(ids, texts, tiers, group, base, group_base)
                    yield out
                    base, group_base, ids, texts, size = base + n, group_base + g, [], [], 0
        if texts:
            yield _packed(ids, texts, tiers, group, base, group_base)[0]

    own = chosen(docs, __id=id_col, __text=text_col)
    return own.select(F.col("__id").cast("long").alias("__id"), "__text").mapInArrow(run, SCHEMA)
