"""Similarity of bit sets and of strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits by all bits, on arrays of bit numbers. Two empty sets count as 1.0."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, 1.0).otherwise(shared / either)


def packed(bits: Column, n_bits: int) -> Column:
    """Bit numbers as 64-bit words."""
    return F.transform(
        F.sequence(F.lit(0), F.lit((n_bits + 63) // 64 - 1)),
        lambda w: F.aggregate(F.filter(bits, lambda b: F.shiftright(b, 6) == w), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int")))),
    )


_CELLS = 1 << 22  # letters of a batch that are compared at once


def _codes(strings: list[str], length: int, blank: int) -> np.ndarray:
    """A row of code points for each string, filled up with ``blank``."""
    sizes = np.array([len(s) for s in strings])
    out = np.full((len(strings), length), blank, np.uint32)
    out[np.arange(length) < sizes[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, all pairs of a batch at once.

    Positions of the longer string are bits of 64-bit words, a row of words for each pair; each letter of the shorter one
    takes one step: a run of set bits that has a match gives up one of them, and the bits that are gone count in the end."""
    longer = [x if len(x) >= len(y) else y for x, y in zip(a, b, strict=True)]
    shorter = [y if len(x) >= len(y) else x for x, y in zip(a, b, strict=True)]
    out = np.zeros(len(longer), np.int64)
    order = np.argsort([len(x) for x in longer], kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(longer[order[end]]) <= _CELLS:
            end += 1
        own = order[at:end]
        words = max(1, -(-max(len(longer[i]) for i in own) // 64))
        left = _codes([longer[i] for i in own], 64 * words, 0xFFFFFFFF)
        right = _codes([shorter[i] for i in own], max(len(shorter[i]) for i in own), 0xFFFFFFFE)
        rows = np.full((len(own), words), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for j in range(right.shape[1]):
            hit = rows & np.packbits(left == right[:, j : j + 1], axis=1, bitorder="little").view("<u8")
            total, carry = rows + hit, np.zeros(len(own), np.uint64)
            over = total < rows
            for w in range(words):
                total[:, w] += carry
                carry = (over[:, w] | (total[:, w] < carry)).astype(np.uint64)
            rows = total | (rows & ~hit)
        out[own] = 64 * words - np.bitwise_count(rows).sum(1, dtype=np.int64)
        at = end
    return out


def common_subsequence(a: str, b: str) -> int:
    return int(common_subsequences([a], [b])[0])


def indel_ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * common_subsequence(a, b) / total if total else 1.0


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Twice the longest common subsequence by both lengths: 1.0 for equal strings, two empty ones included."""

    @F.pandas_udf("double")
    def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            known = (left.notna() & right.notna()).to_numpy()
            x, y = left[known].tolist(), right[known].tolist()
            total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
            out = np.full(len(left), np.nan)
            out[known] = np.where(total > 0, 2 * common_subsequences(x, y) / np.maximum(total, 1), 1.0)
            yield pd.Series(out).where(known, None)

    return ratio(a, b)
