"""Exact top-k by inner product on an impact-ordered index, score at a time.

The index holds vectors in blocks where they lie. A block's postings (vector, dimension, value) stand in
segments by quantised impact, the bit length of the absolute value, highest first, and by dimension within. A chunk of
queries meets an index block segment by segment: each posting adds to the scores of its vector. What the segments left can
still add to a score is at most the product of the query's norm and the norm of the vector's postings in them, which the
index stores. Some exact scores are known by then: the k best of the blocks before, and those of the vectors that lead in
this one. A vector whose score plus what is left stays below the k-th best of them can't be among the k best. When to score
what this proof leaves exactly, in integers, costs less than the next segment's postings, processing stops; otherwise it goes on,
to the last segment at most. Nothing is dropped but by the proof.

Queries are broadcast in blocks of at most ``QUERY_BYTES``. A task keeps the k best of each query
over all its blocks, so what meets for a query is k rows from each task.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; only
vectors of the query's length are compared; rows with the query's own id are not its candidates; repeated
rows are candidates each; ties go to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlens.llm.common import chosen, column, saved

BLOCK, QUERY_BYTES, QUERY_CHUNK = 4096, 16 << 20, 256
INDEX = "dim int, ids array<long>, levels array<int>, sizes array<int>, rows array<int>, dims array<int>, values array<long>"
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, ids = column(batch, "v"), column(batch, "vec_id").to_numpy(zero_copy_only=False)
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat, offsets = vectors.values.to_numpy(), vectors.offsets.to_numpy()
        for dim in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == dim)
            for i in range(0, len(own), BLOCK):
                rows = own[i : i + BLOCK]
                values = flat[offsets[rows][:, None] + np.arange(dim)]
                r, d = np.nonzero(values)
                v = values[r, d]
                level = np.frexp(np.abs(v).astype(np.float64))[1]
                order = np.lexsort((r, d, -level))
                levels, sizes = np.unique(-level, return_counts=True)
                parts = (ids[rows].tolist(), (-levels).tolist(), sizes.tolist(), r[order], d[order], v[order])
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.list_(k)) for x, k in zip(parts, kinds, strict=True))], names=[x.split()[0] for x in INDEX.split(", ")])


def _vectors(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    own = chosen(df, i=id_col, x=vector_col)
    return own.select(F.col("i").cast("long").alias(name), quantised(F.col("x")).alias("v")).where(f"v is not null and {name} is not null")


def build(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index over every row that takes part: a row per block."""
    v = _vectors(vectors, id_col, vector_col, "vec_id")
    return saved(v.mapInArrow(_index, INDEX), "impact-index")


class Block:
    def __init__(self, row: dict):
        self.ids = np.array(row["ids"], np.int64)
        self.exact = np.zeros((len(self.ids), row["dim"]), np.int64)
        rows, dims, values = (np.array(row[x], np.int64) for x in ("rows", "dims", "values"))
        self.exact[rows, dims] = values
        ends = np.cumsum([0, *row["sizes"]])
        self.segments = []  # of each segment, dimension by dimension: the vectors and their values
        self.left = np.zeros((len(ends), len(self.ids)))
        for i in range(len(ends) - 2, -1, -1):
            r, d, v = (x[ends[i] : ends[i + 1]] for x in (rows, dims, values))
            cuts = np.flatnonzero(np.diff(d, prepend=-1, append=-1))
            self.segments.insert(0, [(int(d[x]), r[x:y], v[x:y].astype(np.float64)) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
            self.left[i] = np.sqrt(self.left[i + 1] ** 2 + np.bincount(r, v.astype(np.float64) ** 2, len(self.ids)))
        self.sizes = np.diff(ends).tolist()
        self.touched = 0  # components that scores were made from

    def scored(self, rows: np.ndarray, of: np.ndarray, queries: np.ndarray) -> np.ndarray:
        self.touched += len(rows) * self.exact.shape[1]
        out = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 1 << 14):
            out[i : i + (1 << 14)] = (self.exact[rows[i : i + (1 << 14)]] * queries[of[i : i + (1 << 14)]]).sum(1)
        return out

    def best(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector id and exact score of all that may be among the k best; ``floor``: each query's k-th best so far."""
        n, (m, dim) = len(self.ids), queries.shape
        norms, weights = np.linalg.norm(queries.astype(np.float64), axis=1), np.ascontiguousarray(queries.T.astype(np.float64))
        scores = np.zeros((n, m))
        scores[self.ids[:, None] == query_ids[None, :]] = -np.inf
        possible = scores > -np.inf
        for i, segment in enumerate(self.segments):
            for d, rows, values in segment:
                scores[rows] += values[:, None] * weights[d]
            self.touched += self.sizes[i] * m
            if n > k:
                leading = np.argpartition(scores, -k, axis=0)[-k:]
                of = np.broadcast_to(np.arange(m), leading.shape)
                known = np.where(scores[leading, of] > -np.inf, self.scored(leading.ravel(), of.ravel(), queries).reshape(k, m), -np.inf)
                floor = np.maximum(floor, known.min(0))
            slack = self.left[i + 1][:, None] * norms * (1 + 1e-9) + 1e-6
            possible = (scores + slack >= floor) & (scores > -np.inf)
            if i + 1 < len(self.sizes) and possible.sum() * dim <= self.sizes[i + 1] * m:
                break
        rows, of = np.nonzero(possible)
        return of, self.ids[rows], self.scored(rows, of, queries)


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.rows = k, np.full(n, -np.inf), (np.zeros(0, np.int64),) * 3

    def add(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        of, ids, scores = (np.concatenate(x) for x in zip(self.rows, (of, ids, scores), strict=True))
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        last = rank == self.k - 1
        self.floor[of[last]] = scores[last]
        self.rows = (of[rank < self.k], ids[rank < self.k], scores[rank < self.k])


def top_k(index: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's ``k`` best."""
    spark = index.sparkSession
    asked = saved(_vectors(queries, id_col, vector_col, "q"), "queries")
    size = asked.agg(F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()[0] * 8
    blocks = max(1, -(-size * 5 // (QUERY_BYTES * 4)))  # a hash deals unevenly
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        by_dim: dict[int, list] = {}
        for r in own.collect():  # some QUERY_BYTES
            by_dim.setdefault(len(r.v), []).append((r.q, r.v))
        shared = spark.sparkContext.broadcast({d: (np.array([q for q, _ in x], np.int64), np.array([v for _, v in x], np.int64)) for d, x in by_dim.items()})

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: Best(len(ids), k) for d, (ids, _) in shared.value.items()}
            for batch in batches:
                for i in range(batch.num_rows):
                    dim = column(batch, "dim")[i].as_py()
                    if dim not in best:
                        continue
                    block = Block({x: dim if x == "dim" else column(batch, x)[i].values.to_numpy() for x in batch.schema.names})
                    ids, vectors = shared.value[dim]
                    for at in range(0, len(ids), QUERY_CHUNK):
                        some = slice(at, at + QUERY_CHUNK)
                        of, vec, score = block.best(vectors[some], ids[some], k, best[dim].floor[some])
                        best[dim].add(of + at, vec, score)
            for d, own in best.items():
                of, vec, score = own.rows
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[d][0][of]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

        one = index.mapInArrow(search, FOUND)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
