"""Vectorised word scanning over Arrow string batches.

All word classes used here separate words at ASCII bytes only, so they can be found on the UTF-8
bytes without decoding. A batch is cut into slices of a quarter megabyte; within a slice every step
is one numpy pass, no Python object is made per word. Word and window identities are 64-bit
fingerprints: sums of random byte values times powers of an odd base, which makes each of them a
difference of two prefix sums, followed by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALNUM = np.zeros(256, bool)  # ASCII but for 0-9 and letters
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_random = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUES = _random.integers(1, 1 << 64, 256, np.uint64, endpoint=False)
BYTE_POWERS = Powers(int(_random.integers(1, 1 << 62)))
WORD_POWERS = (Powers(int(_random.integers(1, 1 << 62))), Powers(int(_random.integers(1, 1 << 62))))


def prefix_sums(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


class Spans:
    """Order-sensitive fingerprints of any span of a sequence of uint64 values."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.up, self.down = WORD_POWERS[which](len(values) + 1)
        self.sums = prefix_sums(values, self.up[:-1])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.down[first] + (end - first).astype(np.uint64))


@dataclass
class Slice:
    """Rows ``row .. row+len(bounds)-2`` of a batch. ``bounds`` cuts the word arrays by document."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)


def find_words(data: np.ndarray, cuts: np.ndarray, separator: np.ndarray, fold: np.ndarray):
    """Starts, ends and fingerprints of the words of ``data``; no word crosses a position in ``cuts``."""
    inside = ~separator[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = BYTE_POWERS(len(data) + 1)
    sums = prefix_sums(BYTE_VALUES[fold][data], up[:-1])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts])


def scan(texts: pa.Array, separator: np.ndarray, fold: np.ndarray = IDENTITY, slice_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """The words of whole texts, slice by slice. A text over a slice's size is cut at separators while
    it is read and put together again, so memory follows its number of words."""
    offsets, data = text_buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
        own = data[offsets[row] : offsets[end]]
        cuts = offsets[row : end + 1] - offsets[row]
        if len(own) <= 2 * slice_bytes:
            starts, ends, hashes = find_words(own, cuts, separator, fold)
        else:
            parts, at = [], 0
            while at < len(own):
                to = min(len(own), at + slice_bytes)
                while to < len(own) and not separator[own[to]]:
                    gap = np.flatnonzero(separator[own[to : to + slice_bytes]])
                    to = to + int(gap[0]) if len(gap) else min(len(own), to + slice_bytes)
                s, e, h = find_words(own[at:to], np.zeros(0, np.int64), separator, fold)
                parts.append((s + at, e + at, h))
                at = to
            starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield Slice(row, own, starts, ends, hashes, np.searchsorted(starts, cuts, "left"))
        row = end


def windows(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of ``n`` words that lies within one document, and its document."""
    doc = np.repeat(np.arange(len(s)), np.diff(s.bounds))
    first = np.flatnonzero(np.arange(len(doc)) + n <= s.bounds[doc + 1])
    return first, doc[first]
