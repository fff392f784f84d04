"""Line dedup on long lines and on documents of many lines."""

import random

import pytest

from splitlens.llm import line_dedup

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("n", [190, 200, 3000, 40_000])
def test_one_edit_anywhere_in_a_long_line(spark, n):
    r = random.Random(n)
    base = [f"w{r.randrange(500)}" for _ in range(n)]
    near, far = [], []
    for at in (0, 1, n // 8, n // 2 - 1, n // 2, n - 2, n - 1):
        near += [[*base[:at], "new", *base[at + 1 :]], [*base[:at], *base[at + 1 :]], [*base[:at], "put", *base[at:]]]
    far += [["x", *base[1:-1], "y"], [*base[: n // 2], *base[n // 2 + 2 :]], [*reversed(base)]]
    rows = [(0, " ".join(base)), *[(1 + i, " ".join(x)) for i, x in enumerate(near if n < 10_000 else near[:6])], *[(100 + i, " ".join(x)) for i, x in enumerate(far)]]
    got = {x.doc_id for x in line_dedup.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    edits = lambda a, b: len(a) - len(b) in (-1, 0, 1) and _near(a, b)
    words = {i: t.split() for i, t in rows}
    assert got == {i for i in words if any(j < i and edits(words[j], words[i]) for j in words)}


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    first = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a == b or (len(a) == len(b) and a[first + 1 :] == b[first + 1 :]) or (len(a) < len(b) and a[first:] == b[first + 1 :])


def test_documents_of_many_lines_of_which_many_go(spark):
    lines = [" ".join(f"{w}{i * 7 + k}" for k, w in enumerate("each line has words of its own".split())) for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["its own line, unlike the others", *lines[::2], "", "one more that stays here"])), (3, "nothing\nto see")]
    out = {x.doc_id: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1]["__n_removed"] == 0 and out[3]["__n_removed"] == 0 and out[3].text == "nothing\nto see"
    assert out[2].text == "its own line, unlike the others\n\none more that stays here" and out[2]["__n_removed"] == 10_000
