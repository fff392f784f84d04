import random
import re

import numpy as np
import pyarrow as pa
import pytest

from splitlens.llm.textscan import LOWER, NOT_ALNUM, WHITESPACE, Spans, scan, windows
from splitlens.llm.tokens import Encoder

ALPHABET = list("ab Z'é9.\n\t\r \x0b\x1c\x85\xa0 ​中文🙂,!-") + ["<|endoftext|>", " the", "'s", "  ", "\n\n"]


def texts(n, k=25, seed=1):
    r = random.Random(seed)
    return [None if r.random() < 0.03 else "".join(r.choices(ALPHABET, k=r.randint(0, k))) for _ in range(n)]


@pytest.mark.parametrize("size", [1 << 20, 50, 3])
@pytest.mark.parametrize("table,pattern", [(WHITESPACE, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_those_of_the_pattern(size, table, pattern):
    fold = LOWER if table is NOT_ALNUM else np.arange(256, dtype=np.uint8)
    rows = texts(300)
    seen = 0
    for s in scan(pa.array(rows, pa.string()), table, fold, size):
        for d in range(len(s)):
            text = rows[s.row + d] or ""
            if fold is LOWER:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            got = [fold[s.data[a:b]].tobytes().decode() for a, b in zip(s.starts[s.bounds[d] : s.bounds[d + 1]], s.ends[s.bounds[d] : s.bounds[d + 1]])]
            assert got == re.findall(pattern, text)
            seen += 1
    assert seen == len(rows)


def test_fingerprints_follow_content_not_place():
    s = next(scan(pa.array(["x y z x y", "x y", "y x"]), WHITESPACE))
    spans = Spans(s.hashes)
    first, doc = windows(s, 2)
    h = spans(first, first + 2)
    assert doc.tolist() == [0, 0, 0, 0, 1, 2]
    assert h[0] == h[3] == h[4] and len({h[0], h[1], h[2], h[5]}) == 4


@pytest.mark.parametrize("limit", [3_000_000, 40])
def test_ids_are_those_of_the_library(limit):
    import public_tokenizers

    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), limit)
    rows = texts(3000, seed=2)
    for s in encoder.scan(pa.array(rows, pa.string()), 2000):
        for i in range(len(s.bounds) - 1):
            want = encoder.tokenizer.encode(rows[s.row + i] or "", add_special_tokens=False).ids
            assert s.ids[s.bounds[i] : s.bounds[i + 1]].tolist() == want
