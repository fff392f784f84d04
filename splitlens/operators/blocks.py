"""Block joins: every set of one side meets those of the other that it can be similar to, and no side goes anywhere whole.

Sets are rows of bit matrices. ``packed`` makes blocks of them, rows of a table: sets of neighbouring sizes, at most
``BLOCK_SETS`` of them. How similar two sets can be follows from their sizes, so which blocks meet follows from the blocks' least
and largest sizes; the driver knows these (a few numbers a block) and deals pairs of blocks, ``cells``. A block is
replicated to its cells by a shuffle, and each cell is compared by one product of matrices in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK_SETS, BLOCK_BYTES = 4096, 4 << 20
EPSILON = 1e-9
PRODUCT = 1 << 20  # numbers in one product: a task holds a few matrices of this size, whatever the tables


def matrix(lists: pa.Array, n_bits: int) -> np.ndarray:
    """A row per set, eight bits a byte."""
    out = np.zeros((len(lists), n_bits), bool)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)] = True
    return np.packbits(out, axis=1)


@dataclass(frozen=True)
class Block:
    """Sets of ``low`` to ``high`` elements; of a size that fills more than one block, part ``part`` of ``parts``."""

    no: int
    low: int
    high: int
    part: int = 0
    parts: int = 1

    def alike(self, other: Block) -> float:
        """Tanimoto similarity that sets of two blocks can have at most: the least size by the largest."""
        small, large = (self, other) if self.high <= other.high else (other, self)
        return 1.0 if large.low <= small.high else small.high / large.low


def size_blocks(sizes: dict[int, int], most: int) -> list[Block]:
    """Blocks of about ``most`` sets, in order of size, given the number of sets by size."""
    out: list[Block] = []
    held: list[int] = []

    def close() -> None:
        if held:
            out.append(Block(len(out), held[0], held[-1]))
            held.clear()

    n_held = 0
    for size, n in sorted(sizes.items()):
        if n_held + n > most:
            close()
            n_held = 0
        if n > most:
            parts = math.ceil(1.25 * n / most)  # a hash deals unevenly
            out += [Block(len(out) + k, size, size, k, parts) for k in range(parts)]
        else:
            held.append(size)
            n_held += n
    close()
    return out


def histogram(sized: DataFrame) -> tuple[dict[int, int], int]:
    """Number of sets by size, and the elements of their domain, 8 at least: a row for each size goes to the driver."""
    found = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("bits")).alias("most")).collect()
    return {r["size"]: r.n for r in found}, max(8, max((r.most for r in found if r.most is not None), default=-1) + 1)


def blocks_of(sizes: dict[int, int], n_bits: int, tasks: int) -> list[Block]:
    """Blocks that are small enough for memory, and enough of them for ``tasks`` to have a share."""
    row = n_bits // 8 + 40
    return size_blocks(sizes, max(1, min(BLOCK_SETS, BLOCK_BYTES // row, math.ceil(sum(sizes.values()) / max(1, math.isqrt(2 * tasks))))))


def dealt(sized: DataFrame, blocks: list[Block], id_col: str = "id") -> DataFrame:
    """``sized`` with the number of each row's ``block``, by its size, and the hash of its id where a size has several."""
    by_size = [(size, b.no, b.parts) for b in blocks if b.part == 0 for size in range(b.low, b.high + 1)]
    table = F.broadcast(sized.sparkSession.createDataFrame(by_size, "size int, first int, parts int"))  # a row for each size
    return sized.join(table, "size").withColumn("block", (F.col("first") + F.pmod(F.xxhash64(id_col), F.col("parts"))).cast("int")).drop("first", "parts")


def packed(sized: DataFrame, blocks: list[Block], n_bits: int, more: tuple[str, ...] = ()) -> DataFrame:
    """``sized`` (``id``, ``bits``, ``size``) as one row a block: ``block``, ``ids``, ``sizes``, ``packed``, and a list for each column of ``more``."""
    kind = sized.schema["id"].dataType.simpleString()
    own = dealt(sized, blocks).select("block", "id", "bits", "size", *more)
    lists = "".join(f", `{c}` array<{sized.schema[c].dataType.simpleString()}>" for c in more)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        bits = rows["bits"].chunk(0)
        data = matrix(bits, n_bits).tobytes()
        one = lambda name: pa.array([rows[name].chunk(0)], pa.list_(rows[name].type))
        return pa.table({"block": rows["block"].slice(0, 1), "ids": one("id"), "sizes": one("size"), "packed": pa.array([data], pa.binary())} | {c: one(c) for c in more})

    return own.groupBy("block").applyInArrow(pack, f"block int, ids array<{kind}>, sizes array<int>, packed binary{lists}")


@dataclass
class Rows:
    """A block in a task."""

    ids: pa.Array
    sizes: np.ndarray
    packed: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, n_bits: int) -> Rows:
        row = table.combine_chunks()
        ids = row["ids"].chunk(0).flatten()
        return cls(ids, row["sizes"].chunk(0).flatten().to_numpy(zero_copy_only=False), np.frombuffer(row["packed"][0].as_buffer(), np.uint8).reshape(len(ids), -1))

    def bits(self, at: slice, n_bits: int) -> np.ndarray:
        return np.unpackbits(self.packed[at], axis=1, count=n_bits).astype(np.float32)


def products(a: Rows, b: Rows, n_bits: int, most: int = PRODUCT):
    """Shared elements of all sets of ``a`` with runs of ``b``: where the run begins, and the matrix."""
    rows, step = a.bits(slice(None), n_bits), max(1, most // max(len(a.ids), n_bits, 1))
    for at in range(0, len(b.ids), step):
        yield at, rows @ b.bits(slice(at, at + step), n_bits).T


def meet(left: DataFrame, right: DataFrame, cells: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``compare`` of the blocks of each cell (``i`` of ``left``, ``j`` of ``right``); a block that got no row meets none."""
    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def compared(a: pa.Table, b: pa.Table) -> pa.Table:
        return compare(a, b) if a.num_rows and b.num_rows else none

    side = lambda blocks, own: cells.join(blocks, F.col(own) == F.col("block")).select(*[F.col(c).alias(c) for c in ("i", "j", *blocks.columns) if c != "block"])
    a, b = side(left, "i"), side(right, "j")
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(compared, schema)


def meet_in_parts(own: DataFrame, cells: DataFrame, compare: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``meet`` of blocks with their like, of which ``compare`` yields the rows part by part: a task holds two blocks and one part."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("right")
        if len(rows) == 2:
            yield from compare(rows.slice(0, 1), rows.slice(1, 1))

    side = lambda c, right: cells.join(own, F.col(c) == F.col("block")).select("i", "j", F.lit(right).alias("right"), *[c for c in own.columns if c != "block"])
    return side("i", 0).unionByName(side("j", 1)).groupBy("i", "j").applyInArrow(compared, schema)


def cells_of(spark, partners: list[tuple[int, list[range]]]) -> DataFrame:
    """``i`` and ``j``, from each left block's runs of right blocks."""
    runs = [(i, r.start, r.stop - 1) for i, ranges in partners for r in ranges if len(r)]
    table = spark.createDataFrame(runs, "i int, low int, high int")
    return table.select("i", F.explode(F.sequence("low", "high")).alias("j"))
