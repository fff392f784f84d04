"""Document quality from its lines, by a linear-chain conditional random field.

A text is cut into lines at newlines; lines of white space alone are left out. Each line has ``FEATURES`` numbers that follow
from its bytes and words: shares of classes of bytes, length, length of words, repetition of words within the line, next to
each other and of whole lines within the document. A line's potential is a linear function of its own numbers and those of
the line before and the line behind; a two by two matrix scores the step from a line's label to the next one's. Forward
and backward passes give each line's probability of being good; the document's is their mean, weighted by the lines' bytes, put
through a logistic curve that is fitted with the field.

Labels say whether a document is good, not a line. All lines of good documents are good. Lines of bad documents are bad at
first; then, ``ROUNDS`` times, those that the field holds for good become good, the surest first, while half of the
document's bytes stay bad, and the field is fitted again.

The fit sees at most ``SAMPLE`` documents of each label, those with the least hash of their id, and of each at most
``FIT_LINES`` consecutive lines, which start at a place that the text's hash chooses; features are computed where
the documents lie, and the driver gets numbers only (``SAMPLE`` x ``FIT_LINES`` x ``FEATURES`` floats a label at most). Scoring
reads whole texts: lines by vectorised passes, the chain in blocks of the square root of its lines, so memory and
time follow the text's size. No score depends on anything but the text.

Defined results: a text without words (null, empty) has no line, and its score is the smoothed share of label 1 among
such documents of the fit; a document whose labels contradict each other, or are null, isn't learned from; without both labels
every score is the smoothed share of label 1 (a half without any label); rows with the same text have the same score, repeated ids
included; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import chosen, flat, lean, place
from splitlens.llm.textscan import IDENTITY, WHITESPACE, Spans, mix, scan

SAMPLE, FIT_LINES, ROUNDS, PENALTY, STEPS = 3000, 256, 2, 1e-3, 80
SCORE, LINES, BAD = "__quality", "__n_lines", "__n_bad_lines"
PRIOR, WEIGHT = 0.5, 2.0  # of a share of few documents

_CLASSES = np.zeros((6, 256), np.float32)
_CLASSES[0, 0x41:0x5B] = 1  # capital letters
_CLASSES[1, 0x61:0x7B] = 1  # small letters
_CLASSES[2, 0x30:0x3A] = 1  # digits
_CLASSES[3, [0x2E, 0x2C, 0x3B, 0x3A, 0x27, 0x22, 0x28, 0x29, 0x2D]] = 1  # marks that prose has
_CLASSES[4, 0x21:0x7F] = 1  # other marks
_CLASSES[4] -= _CLASSES[:4].sum(0)
_CLASSES[5, 0x80:] = 1  # bytes beyond ASCII
NAMES = ["capitals", "small letters", "digits", "prose marks", "other marks", "beyond ASCII", "bytes (log)", "words (log)", "bytes a word", "different words", "same word twice", "words in capitals", "words that end in a mark", "line said before"]
FEATURES = len(NAMES)


def _lines(s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each line of a slice, one past its last, and its document; lines have a word at least."""
    newline = np.flatnonzero(s.data == 0x0A)
    line = np.searchsorted(newline, s.starts)
    doc = np.repeat(np.arange(len(s)), np.diff(s.bounds))
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])) if len(line) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(line)), doc[first] if len(first) else first


def _per(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[end] - sums[first]


def _repeats(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier in the same group."""
    order = np.lexsort((np.arange(len(key)), key, group))
    again = np.zeros(len(key), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    return again


def line_features(s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines of a slice, their bytes, and where each document's lines begin and end."""
    first, end, doc = _lines(s)
    cuts = np.searchsorted(doc, np.arange(len(s) + 1))
    if not len(first):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0), cuts
    begin, stop = s.starts[first], s.ends[end - 1]
    size, words = (stop - begin).astype(np.float64), (end - first).astype(np.float64)
    out = np.empty((len(first), FEATURES), np.float32)
    for k, of in enumerate(_CLASSES):
        out[:, k] = _per(of[s.data], begin, stop) / size
    line = np.repeat(np.arange(len(first)), end - first)
    big = np.concatenate([[0], np.cumsum(_CLASSES[0][s.data])])
    small = np.concatenate([[0], np.cumsum(_CLASSES[1][s.data])])
    capitals = (big[s.ends] - big[s.starts] >= 2) & (small[s.ends] == small[s.starts])
    twice = np.concatenate([[False], (s.hashes[1:] == s.hashes[:-1]) & (line[1:] == line[:-1])])
    out[:, 6], out[:, 7] = np.log1p(size), np.log1p(words)
    out[:, 8] = np.minimum(size / words, 40) / 8
    some = words + 3  # a word or two of a short line prove little
    out[:, 9] = 1 - _per(_repeats(line, s.hashes), first, end) / some
    out[:, 10] = _per(twice, first, end) / some
    out[:, 11] = _per(capitals, first, end) / some
    out[:, 12] = _per(_CLASSES[4][s.data[s.ends - 1]], first, end) / some
    out[:, 13] = _repeats(doc, Spans(s.hashes)(first, end))
    return out, size, cuts


def with_neighbours(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and behind (0 at a document's ends), and a constant."""
    before, behind = np.zeros_like(x), np.zeros_like(x)
    before[1:], behind[:-1] = x[:-1], x[1:]
    edges = cuts[(cuts > 0) & (cuts < len(x))]
    before[edges], behind[edges - 1] = 0, 0
    return np.hstack([x, before, behind, np.ones((len(x), 1), x.dtype)])


def _running(steps: np.ndarray) -> np.ndarray:
    """Row vectors (1, 1) times the products of the first i matrices, for each i, scaled to a sum of 1. Products are made
    in blocks of about the root of their number, side by side, then blocks are put behind each other."""
    n = len(steps)
    block = max(1, int(np.sqrt(n)))
    rows = -(-n // block)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(2), (rows * block - n, 2, 2))]).reshape(rows, block, 2, 2)
    within = np.empty_like(padded)
    within[:, 0] = padded[:, 0]
    for k in range(1, block):
        product = within[:, k - 1] @ padded[:, k]
        within[:, k] = product / product.sum((1, 2), keepdims=True)
    at, heads = np.ones(2), np.empty((rows, 2))
    for r in range(rows):
        heads[r] = at
        at = at @ within[r, -1]
        at = at / at.sum()
    out = np.einsum("ri,rkij->rkj", heads, within).reshape(-1, 2)[:n]
    return out / out.sum(1, keepdims=True)


def marginals(potential: np.ndarray, step: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line, and the expected steps (bad or good to bad or good) over all documents. ``potential``
    is the log odds of good by features; documents' chains begin at ``cuts``, where the product forgets what was before."""
    n = len(potential)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    good = 0.5 * np.clip(potential, -30, 30)
    emit = np.exp(np.stack([-good, good], 1) - np.abs(good)[:, None])
    move = np.exp(step - step.max())
    start = np.zeros(n, bool)
    start[cuts[:-1][np.diff(cuts) > 0]] = True
    last = np.append(start[1:], True)
    ahead = np.where(start[:, None, None], 1.0, move[None]) * emit[:, None, :]
    alpha = _running(ahead)
    behind = np.where(last[:, None, None], 1.0, (move.T[None] * np.roll(emit, -1, 0)[:, :, None]))  # from i + 1 back to i
    beta = _running(behind[::-1])[::-1]
    both = alpha * beta
    p = both[:, 1] / both.sum(1)
    inner = ~start
    pairs = alpha[:-1][inner[1:], :, None] * move[None] * (emit * beta)[1:][inner[1:], None, :]
    expected = (pairs / pairs.sum((1, 2), keepdims=True)).sum(0) if len(pairs) else np.zeros((2, 2))
    return p, expected


def log_likelihood(potential: np.ndarray, step: np.ndarray, cuts: np.ndarray, labels: np.ndarray) -> float:
    """Of given labels of all lines, by a plain forward pass; tests compare gradients with it."""
    total = 0.0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        score, forward = 0.0, None
        for i in range(a, b):
            own = np.array([-0.5, 0.5]) * potential[i]
            forward = own if forward is None else np.logaddexp(forward[0] + step[0], forward[1] + step[1]) + own
            score += own[labels[i]] + (step[labels[i - 1], labels[i]] if i > a else 0.0)
        total += score - np.logaddexp(*forward) if b > a else 0.0
    return total


def _field(x: np.ndarray, cuts: np.ndarray, labels: np.ndarray, weight: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and step scores that fit ``labels``, by gradient steps with moments (Adam) from the given ones."""
    start = np.zeros(len(x), bool)
    start[cuts[:-1][np.diff(cuts) > 0]] = True
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][~start[1:]], labels[1:][~start[1:]]), 1.0)
    theta = np.concatenate([weight, step.ravel()])
    m = v = np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        p, expected = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), cuts)
        slope = np.concatenate([x.T @ (labels - p), (seen - expected).ravel()]) / max(1, len(x)) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta = theta + 0.15 * (1 - 0.9 * t / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _relabelled(p: np.ndarray, size: np.ndarray, cuts: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of lines: 1 in good documents; in bad ones, of lines held for good the surest, while half the bytes stay bad."""
    out = np.repeat(good, np.diff(cuts)).astype(np.int64)
    for a, b in zip(cuts[:-1][good == 0], cuts[1:][good == 0], strict=True):
        order = a + np.argsort(-p[a:b], kind="stable")
        fits = np.cumsum(size[order]) <= 0.5 * size[a:b].sum()
        out[order[fits & (p[order] > 0.5)]] = 1
    return out


def _weighted(p: np.ndarray, size: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return _per(p * size, cuts[:-1], cuts[1:]) / np.maximum(_per(size, cuts[:-1], cuts[1:]), 1)


@dataclass(frozen=True)
class Field:
    """A fitted model. ``weight`` is None where there was nothing to tell labels apart by."""

    empty: float
    weight: np.ndarray | None = None
    step: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    curve: tuple[float, float] = (0.0, 1.0)

    def lines(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return marginals(with_neighbours(z, cuts).astype(np.float64) @ self.weight, self.step, cuts)[0]

    def score(self, quality: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * quality))), 9)  # sums differ in the last bits by what else is scored


def _curve(q: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of documents' quality to their label, by Newton's steps; it never falls."""
    x = np.stack([np.ones_like(q), q], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ theta))
        slope = x.T @ (y - p) - 1e-2 * theta
        theta = theta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), slope)
    return float(theta[0]), max(float(theta[1]), 0.0)


def fitted(x: np.ndarray, size: np.ndarray, cuts: np.ndarray, good: np.ndarray, empty: float) -> Field:
    """A field from lines' features and bytes, documents' cuts and labels."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = with_neighbours(np.clip((x - mean) / scale, -5, 5), cuts).astype(np.float64)
    labels, weight, step = np.repeat(good, np.diff(cuts)).astype(np.int64), np.zeros(z.shape[1]), np.zeros((2, 2))
    for k in range(ROUNDS + 1):
        weight, step = _field(z, cuts, labels, weight, step)
        p = marginals(z @ weight, step, cuts)[0]
        if k < ROUNDS:
            labels = _relabelled(p, size, cuts, good)
    return Field(empty, weight, step, mean, scale, _curve(_weighted(p, size, cuts), good.astype(np.float64)))


FIT_ROW = "good int, sizes array<float>, features array<float>"


def _sampled(batches: Iterator[pa.RecordBatch], most: int = FIT_LINES) -> Iterator[pa.RecordBatch]:
    """Label, lines' bytes and features of each document: at most ``most`` consecutive lines from a place by its text."""
    for batch in batches:
        good = batch.column(1)
        for s in scan(batch.column(0), WHITESPACE, IDENTITY):
            x, size, cuts = line_features(s)
            sizes, features = [], []
            for d in range(len(s)):
                a, b = int(cuts[d]), int(cuts[d + 1])
                if b - a > most:
                    own = mix(s.hashes[s.bounds[d] : s.bounds[d + 1]]).sum(dtype=np.uint64)
                    a += int(own % np.uint64(b - a - most + 1))
                    b = a + most
                sizes.append(size[a:b].astype(np.float32))
                features.append(x[a:b].ravel())
            rows = len(s)
            yield pa.RecordBatch.from_arrays([good.slice(s.row, rows), pa.array(sizes, pa.list_(pa.float32())), pa.array(features, pa.list_(pa.float32()))], names=["good", "sizes", "features"])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Field:
    """A field from the labelled of ``documents``: at most ``sample`` of each label, by the hash of their id."""
    spark = documents.sparkSession
    marks = chosen(labels, id=id_col, good=label_col).where("id is not null and good in (0, 1)")
    clear = marks.groupBy("id").agg(F.min("good").cast("int").alias("good"), F.max("good").cast("int").alias("most")).where("good = most").drop("most")
    known = clear.join(chosen(documents, id=id_col).distinct(), "id", "left_semi").withColumn("order", F.xxhash64("id"))
    picked = [r for k in (0, 1) for r in known.where(F.col("good") == k).orderBy("order", "id").limit(sample).collect()]  # at most 2 * sample ids
    if not picked:
        return Field(PRIOR)
    ids = F.broadcast(spark.createDataFrame(picked, known.schema).drop("order"))
    texts = chosen(documents, id=id_col, text=text_col).join(ids, "id").select("text", "good")
    rows = texts.mapInArrow(lean(_sampled), FIT_ROW).toArrow().combine_chunks()
    good = rows["good"].to_numpy()
    count = rows["sizes"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
    bare = good[count == 0]
    empty = float((bare.sum() + WEIGHT * PRIOR) / (len(bare) + WEIGHT))
    has = np.flatnonzero(count > 0)
    if len(set(good[has].tolist())) < 2:
        return Field(float((good.sum() + WEIGHT * PRIOR) / (len(good) + WEIGHT)))
    sizes, features = rows["sizes"].to_pylist(), rows["features"].to_pylist()
    order = sorted(has.tolist(), key=lambda i: (good[i], sizes[i], features[i]))  # the same sums whatever order rows come in
    cuts = np.concatenate([[0], np.cumsum(count[order])])
    x = np.array([v for i in order for v in features[i]], np.float32).reshape(-1, FEATURES)
    return fitted(x, np.array([v for i in order for v in sizes[i]], np.float64), cuts, good[order].astype(np.int64), empty)


def scored(documents: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """``documents`` with their score (``SCORE``), how many lines they have (``LINES``) and how many of these are bad (``BAD``)."""
    rows, at = flat(documents), place(documents, text_col)
    kind = rows.schema
    where = rows.columns.index(at)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, lines, bad = [np.full(batch.num_rows, model.empty)], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            score = score[0]
            for s in scan(batch.column(where), WHITESPACE, IDENTITY):
                if model.weight is None:
                    break
                x, size, cuts = line_features(s)
                p = model.lines(x, cuts)
                own = slice(s.row, s.row + len(s))
                lines[own], bad[own] = np.diff(cuts), _per(p < 0.5, cuts[:-1], cuts[1:]).astype(np.int64)
                score[own] = np.where(lines[own] > 0, model.score(_weighted(p, size, cuts)), model.empty)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(lines), pa.array(bad)], names=[*batch.schema.names, "s", "n", "b"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    found = rows.mapInArrow(lean(judge), f"{fields}, s double, n long, b long")
    return found.toDF(*documents.columns, SCORE, LINES, BAD)
