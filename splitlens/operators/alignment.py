"""Global alignment of target sequences, and each sequence's best reference.

The kernel is an affine-gap global alignment, a row of the matrix at a time. It keeps a row for each square root of their number
and makes the rows between anew on the way back, so two sequences of 35,000 residues take some 300 MB. The substitution
scores are a parameter (``Scoring``); the default is the published BLOSUM62 matrix, a gap's first place costs 12, each further
one 2. Pairs are aligned in their sorted order, so that both sides
score alike.

How identical two sequences can be follows from their lengths and from the runs of residues that they share (``GramIndex``).
References are tried in the order of that bound, and those whose bound is below the best identity so far aren't aligned. The
search is a block join (``blocks``): no side goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.operators import blocks
from splitlens.session import written

CLOSE = 99.99  # identity per cent that ends a search
SURELY_EQUAL = 9999  # below that length nothing but an equal sequence is as good as equal
BLOCK = 2048  # sequences of a block
RESULT = "score double, identity_pct double, similarity_pct double, length int, n_gaps int, gaps_pct double, aligned_a string, aligned_b string"

#: The BLOSUM62 substitution matrix (Henikoff and Henikoff, 1992), rows and columns in this order.
BLOSUM62_LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""


def blosum62() -> dict[tuple[str, str], float]:
    rows = [line.split() for line in BLOSUM62.strip().splitlines()]
    return {(a, b): float(x) for a, row in zip(BLOSUM62_LETTERS, rows, strict=True) for b, x in zip(BLOSUM62_LETTERS, row, strict=True)}


@dataclass(frozen=True)
class Scoring:
    """Scores of pairs of residues; of residues that aren't listed, ``same`` or ``other``."""

    pairs: Mapping[tuple[str, str], float] = field(default_factory=blosum62)
    same: float = 1.0
    other: float = -4.0
    gap_open: float = 12.0
    gap_extend: float = 2.0

    def score(self, a: str, b: str) -> float:
        given = self.pairs.get((a, b), self.pairs.get((b, a)))
        return given if given is not None else self.same if a == b else self.other


def align(a: str, b: str, scoring: Scoring = Scoring()) -> tuple:
    """``RESULT`` of one pair. With an empty side all is gap: score and identity 0, gaps 100 per cent."""
    if not a or not b:
        n = max(len(a), len(b))
        return (0.0, 0.0, 0.0, n, n, 100.0 if n else 0.0, a or "-" * n, b or "-" * n)
    letters = sorted(set(a) | set(b))
    table = np.array([[scoring.score(x, y) for y in letters] for x in letters])
    ia, ib = (np.array([letters.index(c) for c in s]) for s in (a, b))
    n, m, first, more = len(a), len(b), scoring.gap_open, scoring.gap_extend
    low, places = -1e18, np.arange(m + 1)

    def following(best: np.ndarray, down: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row i from the one before: best scores, of those that end in a gap of ``b``, and in a gap of ``a``."""
        down = np.maximum(best - first, down - more)
        row = down.copy()
        row[1:] = np.maximum(row[1:], best[:-1] + table[ia[i - 1], ib])
        # gaps to the right within the row: the best start so far, its cost rising by a step each place
        start = np.maximum.accumulate(row + more * places)
        right = np.full(m + 1, low)
        right[1:] = start[:-1] - first - more * (places[1:] - 1)
        return np.maximum(row, right), down, right

    top, step = -(first + more * (places - 1)), max(1, math.isqrt(n))
    top[0] = 0
    best, down = top, np.full(m + 1, low)
    kept = {0: (best, down)}
    for i in range(1, n + 1):
        best, down, _ = following(best, down, i)
        if i % step == 0:
            kept[i] = best, down
    score = float(best[m])

    def between(lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows from a kept one to the next."""
        edge = np.full(m + 1, low)
        edge[1:] = top[1:]
        rows = [(*kept[lo], edge)]
        for i in range(lo + 1, min(n, lo + step) + 1):
            rows.append(following(rows[-1][0], rows[-1][1], i))
        return tuple(np.stack(x) for x in zip(*rows, strict=True))

    out_a, out_b, i, j, state = [], [], n, m, "best"
    lo = (n - 1) // step * step
    rows, downs, rights = between(lo)
    while i or j:
        if i == lo and lo:
            lo -= step
            rows, downs, rights = between(lo)
        k = i - lo
        if state == "best":
            if i and j and rows[k, j] == rows[k - 1, j - 1] + table[ia[i - 1], ib[j - 1]]:
                out_a.append(a[i - 1])
                out_b.append(b[j - 1])
                i, j = i - 1, j - 1
                continue
            state = "down" if i and rows[k, j] == downs[k, j] else "right"
        if state == "down":
            state = "best" if downs[k, j] == rows[k - 1, j] - first else "down"
            out_a.append(a[i - 1])
            out_b.append("-")
            i -= 1
        else:
            state = "best" if j == 0 or rights[k, j] == rows[k, j - 1] - first or (i == 0 and j == 1) else "right"
            out_a.append("-")
            out_b.append(b[j - 1])
            j -= 1
    x, y = "".join(reversed(out_a)), "".join(reversed(out_b))
    same = sum(p == q for p, q in zip(x, y, strict=True))
    like = sum(p != "-" and q != "-" and scoring.score(p, q) > 0 for p, q in zip(x, y, strict=True))
    gaps = x.count("-") + y.count("-")
    return (score, 100 * same / len(x), 100 * like / len(x), len(x), gaps, 100 * gaps / len(x), x, y)


def aligner(scoring: Scoring = Scoring()):
    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for a, b in batches:
            yield pd.DataFrame([align(x, y, scoring) for x, y in zip(a, b, strict=True)], columns=names)

    return run


def best_key(identity: Column, score: Column, reference: Column) -> Column:
    """Orders alignments of a query, best least: the first reference that is as good as equal, if any; else by
    identity, then score, then reference."""
    close = identity >= CLOSE
    return F.struct(F.when(close, 0).otherwise(1), F.when(~close, -identity), F.when(~close, -score), reference)


def best_alignments(alignments: DataFrame) -> DataFrame:
    """Best row of each ``query`` by ``best_key``, of rows that are alike in it the least by all columns in their order;
    columns ``query``, ``reference``, ``identity_pct``, ``score``, ..."""
    row = F.struct(*alignments.columns)
    key = F.struct(best_key(F.col("identity_pct"), F.col("score"), F.col("reference")), row)
    return alignments.groupBy("query").agg(F.min_by(row, key).alias("r")).select("r.*")


def most_identical(a: str, b: str) -> float:
    """Identity in per cent that two sequences can have at most, by their lengths."""
    if a == b:
        return 100.0
    return 100 * min(len(a), len(b) - (len(a) == len(b))) / max(len(a), len(b), 1)


class GramIndex:
    """Inverted index of the runs of 1, 2 and 3 residues of sequences, which bounds their identity to a query.

    An alignment of L columns with m equal ones has them in at most L - m + 1 runs, so at least m - (q - 1)(L - m + 1) of
    the q-grams of both sides are shared. With s shared ones, m / L is at most (q - 1) / q + (s + q - 1) / (q L), which
    falls with L, and L is at least the longer length."""

    SIZES = (1, 2, 3)

    def __init__(self, sequences: list[str]):
        self.sequences = sequences
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.postings = []
        for q in self.SIZES:
            grams = [self._grams(s, q) for s in sequences]
            owner = np.repeat(np.arange(len(sequences)), [len(g) for g in grams])
            codes = np.concatenate([*grams, np.zeros(0, np.uint64)])
            order = np.lexsort((owner, codes))
            codes, owner = codes[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])) if len(codes) else np.zeros(0, np.int64)
            self.postings.append((codes[new], owner[new], np.diff(np.append(new, len(codes)))))

    @staticmethod
    def _grams(sequence: str, q: int) -> np.ndarray:
        code = np.frombuffer(sequence.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out = code[: max(0, len(code) - q + 1)]
        for k in range(1, q):
            out = out << np.uint64(21) | code[k : k + len(out)]
        return out

    def shared(self, query: str, which: int) -> np.ndarray:
        """Grams that each sequence shares with the query, as multisets."""
        codes, owner, count = self.postings[which]
        asked, times = np.unique(self._grams(query, self.SIZES[which]), return_counts=True)
        low, high = np.searchsorted(codes, asked), np.searchsorted(codes, asked, "right")
        sizes = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(asked) else np.zeros(0, np.int64)
        return np.bincount(owner[at], np.minimum(count[at], np.repeat(times, sizes)), len(self.sequences))

    def bounds(self, query: str) -> np.ndarray:
        """Identity in per cent that each sequence can have at most to the query."""
        longer, shorter = np.maximum(self.lengths, len(query)), np.minimum(self.lengths, len(query))
        best = (shorter - (self.lengths == len(query))) / np.maximum(longer, 1)
        for which, q in enumerate(self.SIZES):
            best = np.minimum(best, (q - 1) / q + (self.shared(query, which) + q - 1) / (q * np.maximum(longer, 1)))
        same = np.array([s == query for s in self.sequences], bool)
        return np.where(same, 100.0, 100 * best + 1e-9)


def _search(query: str, references: list[str], scoring: Scoring, bounds: np.ndarray | None = None, least: float = -1.0) -> tuple[str, tuple, int] | None:
    """Best of the sorted ``references`` by ``best_key``, and how many were aligned: those that may be as good as equal in
    their order, up to the first that is, and then the others, the most promising first, until none can reach the best
    identity, or ``least``, which another reference is known to have. None if none can."""
    bounds = GramIndex(references).bounds(query) if bounds is None else bounds
    close = np.flatnonzero(bounds >= CLOSE)
    others = np.flatnonzero((bounds < CLOSE) & (bounds >= least))
    best: tuple[str, tuple] | None = None
    n = 0
    for i in [*close, *others[np.argsort(-bounds[others], kind="stable")]]:
        if best is not None and bounds[i] < best[1][1]:
            break
        r, n = references[i], n + 1
        done = align(min(query, r), max(query, r), scoring)  # one order for a pair, so that it scores alike from both sides
        if done[1] >= CLOSE:
            return r, done, n
        if best is None or (-done[1], -done[0], r) < (-best[1][1], -best[1][0], best[0]):
            best = r, done
    return None if best is None else (*best, n)


FOUND = "query string, reference string, score double, identity_pct double, similarity_pct double, length int, gaps_pct double, n_aligned long"


def _rows(found: list[tuple[str, str, tuple, int]]) -> pa.Table:
    """``FOUND`` of (query, reference, ``RESULT``, number aligned)."""
    rows = [(q, r, d[0], d[1], d[2], d[3], d[5], n) for q, r, d, n in found]
    kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.int64()]
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def nearest_sequences(queries: DataFrame, references: DataFrame, scoring: Scoring = Scoring(), block: int = BLOCK) -> DataFrame:
    """For each distinct sequence (column ``seq``) of ``queries`` the best of ``references`` by ``best_key``, and ``n_aligned``, the
    references that it was aligned with.

    A query that is among the references is settled by a join, unless it is so long that another one could be as good as
    equal. The others meet blocks of at most ``block`` references, indexed by their grams, in two rounds: the first finds the most
    promising reference of each query and aligns it; the second aligns only those whose bound reaches its identity."""
    spark = queries.sparkSession
    distinct = lambda df: df.select("seq").where("seq is not null").distinct().withColumn("size", F.length("seq"))
    asked, refs = written(distinct(queries), "queries"), written(distinct(references), "references")
    short = F.col("size") < SURELY_EQUAL
    equal = asked.where(short).join(refs.select("seq"), "seq", "left_semi")
    left = asked.join(refs.where(short).select("seq"), "seq", "left_anti")
    sizes = lambda df: {r["size"]: r.n for r in df.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    own, other = sizes(left), sizes(refs)

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows([(s, s, align(s, s, scoring), 1) for s in batch.column(0).to_pylist()]).to_batches()

    found = equal.select("seq").mapInArrow(itself, FOUND)
    if not own or not other:
        return best_alignments(found)
    tasks = spark.sparkContext.defaultParallelism
    share = lambda n: max(1, min(block, math.ceil(n / max(1, math.isqrt(2 * tasks)))))
    made, met = (blocks.size_blocks(s, share(sum(s.values()))) for s in (own, other))
    right = written(blocks.dealt(refs, met, "seq").groupBy("block").agg(F.sort_array(F.collect_list("seq")).alias("seqs")), "reference-blocks")
    placed = written(blocks.dealt(left, made, "seq").select("seq", "block"), "query-blocks")
    all_cells = blocks.cells_of(spark, [(q.no, [range(len(met))]) for q in made])

    def promising(a: pa.Table, b: pa.Table) -> pa.Table:
        index, out = GramIndex(b["seqs"][0].as_py()), []
        for query in a["seqs"][0].as_py():
            bounds = index.bounds(query)
            out.append((query, index.sequences[int(bounds.argmax())], float(bounds.max())))
        return pa.table({"query": pa.array([x[0] for x in out], pa.string()), "reference": pa.array([x[1] for x in out], pa.string()), "bound": pa.array([x[2] for x in out], pa.float64())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield from _rows([(q, r, align(min(q, r), max(q, r), scoring), 1) for q, r in pairs]).to_batches()

    seqs = placed.groupBy("block").agg(F.collect_list("seq").alias("seqs"))
    guess = blocks.meet(seqs, right, all_cells, promising, "query string, reference string, bound double")
    guess = guess.groupBy("query").agg(F.min_by("reference", F.struct(-F.col("bound"), F.col("reference"))).alias("reference"))
    known = written(guess.repartition(max(1, tasks)).mapInArrow(first, FOUND), "alignments")
    after = placed.join(known.select(F.col("query").alias("seq"), F.col("reference").alias("guess"), F.col("identity_pct").alias("least")), "seq")
    floors = {r.block: r.least for r in after.groupBy("block").agg(F.min("least").alias("least")).collect()}  # a row for each block
    cells = blocks.cells_of(spark, [(q.no, [range(r.no, r.no + 1) for r in met if 100 * q.alike(r) + 1e-9 >= floors.get(q.no, 0.0)]) for q in made])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        index, out = GramIndex(b["seqs"][0].as_py()), []
        at = {s: i for i, s in enumerate(index.sequences)}
        for query in a["seqs"][0].as_py():
            bounds = index.bounds(query["seq"])
            if query["guess"] in at and query["least"] < CLOSE:
                bounds[at[query["guess"]]] = -2.0  # it is aligned already
            best = _search(query["seq"], index.sequences, scoring, bounds, query["least"])
            if best is not None:
                out.append((query["seq"], *best))
        return _rows(out)

    with_known = after.groupBy("block").agg(F.collect_list(F.struct("seq", "guess", "least")).alias("seqs"))
    searched = blocks.meet(with_known, right, cells, search, FOUND)
    every = found.unionByName(known).unionByName(searched)
    counts = every.groupBy("query").agg(F.sum("n_aligned").alias("n_aligned"))
    return best_alignments(every.drop("n_aligned")).join(counts, "query")


def alignment_summary(best: DataFrame) -> DataFrame:
    stats = [a for c in ("identity_pct", "score", "similarity_pct") for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return best.agg(F.count(F.lit(1)).alias("n"), *stats)


def top_alignments(best: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best over all comparisons (``comparison`` number) by identity and score, then by all columns."""
    return best.orderBy(F.desc("identity_pct"), F.desc("score"), "comparison", "query", *[c for c in best.columns if c not in ("identity_pct", "score", "comparison", "query")]).limit(k)
