"""Token ids of whole texts, exactly as the tokenizers library gives them, at a multiple of its speed.

A byte-level BPE splits a text by a fixed pattern first and merges within the pieces only. No piece
reaches from a character that isn't white space over white space that follows. So a text may be cut
before any run of ASCII white space that follows such a character, and the ids of the parts, joined,
are the ids of the whole. Such parts, words with the space before them, repeat: in each slice of a
megabyte every different part is looked up once, and only parts that this worker hasn't kept are given
to the library. Parts are told apart by 64-bit fingerprints. ``CACHE_PARTS`` bounds what a worker keeps;
beyond it parts are asked for again.
Texts with other white space than ASCII's go to the library whole. Strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from splitlens.llm.common import kept_by_worker
from splitlens.llm.textscan import BYTE_POWERS, BYTE_VALUES, WHITESPACE, mix, prefix_sums, text_buffers

CACHE_PARTS = 3_000_000  # some 40 bytes each
JOINED = 256
SLICE_BYTES = 1 << 20


@dataclass
class TokenSlice:
    """Rows ``row .. row+len(bounds)-2``; ``ids[bounds[i]:bounds[i+1]]`` are the ids of one text."""

    row: int
    ids: np.ndarray
    bounds: np.ndarray


def odd_white_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space (or what some tables call so) outside ASCII's tab to return and space."""
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3) | ((data >= 0x1C) & (data <= 0x1F)))
    if not len(lead):
        return lead
    far = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = far[lead], far[lead + 1], far[lead + 2]
    odd = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
    odd |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | (b == 0x81)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return lead[odd]


@dataclass
class Known:
    """Parts by ascending fingerprint: where their ids begin, and how many they are."""

    marks: np.ndarray
    at: np.ndarray
    size: np.ndarray

    @staticmethod
    def empty() -> Known:
        return Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def find(self, marks: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        if len(self.marks):
            place = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
            hit = self.marks[place] == marks
            at[hit], size[hit] = self.at[place[hit]], self.size[place[hit]]

    def merged(self, other: Known) -> Known:
        place = np.searchsorted(self.marks, other.marks)
        return Known(np.insert(self.marks, place, other.marks), np.insert(self.at, place, other.at), np.insert(self.size, place, other.size))


class Encoder:
    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit = cache_parts
        self.known, self.recent = Known.empty(), Known.empty()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0  # ids of known parts, one after another
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of text of each id: a character of the vocabulary is a byte
        for word, i in vocabulary.items():
            self.width[i] = len(word)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ask(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that begin with white space and don't end with it, joined to longer texts; the
        widths of the ids tell where each part ends."""
        joined = [b"".join(parts[i : i + JOINED]).decode() for i in range(0, len(parts), JOINED)]
        ids = np.array([i for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in x.ids], np.uint32)
        return ids, np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(x) for x in parts])) + 1

    def _append(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(max(self.used, len(self.flat)), np.uint32)])
        self.flat[at : self.used] = ids
        return at

    def _parts(self, marks: np.ndarray, part) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of each part lie; ``marks`` ascend, ``part(i)`` gives the bytes of one."""
        at, size = np.zeros(len(marks), np.int64), np.full(len(marks), -1, np.int64)
        for level in (self.known, self.recent):
            level.find(marks, at, size)
        new = np.flatnonzero(size < 0)
        if not len(new):
            return at, size
        before = self.used
        parts = [part(i) for i in new.tolist()]
        inner = np.array([bool(WHITESPACE[x[0]] and not WHITESPACE[x[-1]]) for x in parts])
        if inner.any():
            ids, ends = self._ask([x for x, y in zip(parts, inner.tolist(), strict=True) if y])
            at[new[inner]], size[new[inner]] = self._append(ids) + np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
        if not inner.all():
            each = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x, y in zip(parts, inner.tolist(), strict=True) if not y], add_special_tokens=False)]
            ends = np.cumsum([len(x) for x in each])
            at[new[~inner]], size[new[~inner]] = self._append(np.array([i for x in each for i in x], np.uint32)) + np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
        if len(self.known.marks) + len(self.recent.marks) + len(new) > self.limit:
            self.used = before  # full: what came first, frequent parts among it, stays
        else:
            self.recent = self.recent.merged(Known(marks[new], at[new], size[new]))
            if len(self.recent.marks) > 20_000 + len(self.known.marks) // 8:
                self.known, self.recent = self.known.merged(self.recent), Known.empty()
        return at, size

    def _slice(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that have no odd white space, and their bounds."""
        inside = ~WHITESPACE[data]
        ends = np.zeros(len(data) + 1, bool)  # a part ends after a character that white space follows
        ends[1:-1] = inside[:-1] & ~inside[1:]
        ends[cuts] = True  # and where its text ends
        ends[0] = False
        ends = np.flatnonzero(ends)
        starts = np.concatenate([[0], ends[:-1]])
        up, down = BYTE_POWERS(len(data) + 1)
        sums = prefix_sums(BYTE_VALUES[data], up[:-1])
        marks = mix((sums[ends] - sums[starts]) * down[starts])
        different, first, inverse = np.unique(marks, return_index=True, return_inverse=True)
        at, size = self._parts(different, lambda i: data[starts[first[i]] : ends[first[i]]].tobytes())
        at, size = at[inverse], size[inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(ends, cuts, "right")]

    def scan(self, texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[TokenSlice]:
        offsets, data = text_buffers(texts)
        row, n = 0, len(offsets) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
            own, cuts = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            odd = np.unique(np.searchsorted(cuts, odd_white_space(own), "right") - 1)
            if not len(own):
                ids, bounds = np.zeros(0, np.uint32), np.zeros(len(cuts), np.int64)
            elif not len(odd):
                ids, bounds = self._slice(own, cuts)
            else:
                each, plain = [], np.setdiff1d(np.arange(end - row), odd)
                done = dict(zip(odd.tolist(), (self.whole(own[cuts[i] : cuts[i + 1]].tobytes().decode()) for i in odd.tolist()), strict=True))
                if len(plain):
                    joined = np.concatenate([own[cuts[i] : cuts[i + 1]] for i in plain.tolist()])
                    to = np.concatenate([[0], np.cumsum(np.diff(cuts)[plain])])
                    ids, bounds = self._slice(joined, to) if len(joined) else (np.zeros(0, np.uint32), np.zeros(len(to), np.int64))
                    done |= {i: ids[bounds[k] : bounds[k + 1]] for k, i in enumerate(plain.tolist())}
                each = [done[i] for i in range(end - row)]
                ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
            yield TokenSlice(row, ids, bounds)
            row = end

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.scan(pa.array([text], pa.string()))).ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    return Encoder(path)


kept_by_worker(encoder.cache_clear)
