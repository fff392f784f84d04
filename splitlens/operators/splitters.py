"""Splitters. The seeded orders come from one Mersenne Twister permutation, which has to be drawn in one place: of row
numbers for the random split, and of groups, not rows, for the group split.

Their distributed forms order rows or groups by a digest of seed and key. Where such an order is cut, say behind its k-th
row, is found exactly by rounds of histograms of the digest's leading digits: the driver sees counts, and in the end the
few rows that share the cut's digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.config import check_fractions
from splitlens.session import written

SEED = 123
MOST_ROWS = 200_000_000  # that one permutation is drawn over
NAMES = ("train", "valid", "test")


def random_split(df: DataFrame, fractions=None, seed: int = SEED, row_id: str = "row_id") -> DataFrame:
    """Seed-compatible random split of rows numbered from 0 by ``row_id``; the cuts are train and train + valid times n, cut
    off. More than ``MOST_ROWS`` rows are an error: there ``hashed_split`` serves."""
    train, valid, _ = check_fractions(fractions)
    n, first, last = df.agg(F.count(F.lit(1)), F.min(row_id), F.max(row_id)).first()
    if n and (first, last) != (0, n - 1):
        raise ValueError(f"{row_id} has to number the rows from 0, without gaps")
    if n > MOST_ROWS:
        raise ValueError(f"a seeded permutation of {n} rows is drawn in one place; use hashed_split")
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = int(train * n), int((train + valid) * n)
    side = np.where(place < a, 0, np.where(place < b, 1, 2))
    import pandas as pd

    table = df.sparkSession.createDataFrame(pd.DataFrame({"__row": np.arange(n), "__side": side}), "__row long, __side int")
    names = F.array(*[F.lit(x) for x in NAMES])
    return df.join(table, F.col(row_id) == F.col("__row")).withColumn("split", F.get(names, F.col("__side"))).drop("__row", "__side")


def hashed_split(df: DataFrame, key: str, fractions=None, seed: int = SEED) -> DataFrame:
    """Split by a hash of the key: approximate sizes, no shuffle, the same for every run and for added rows."""
    train, valid, _ = check_fractions(fractions)
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)
    return df.withColumn("split", F.when(at < train, "train").when(at < train + valid, "valid").otherwise("test"))


_DIGITS, _FEW = 3, 2000  # of the digest for a round: 4096 counts; rows that are put in order at once


def _order(key: str | Column, seed: int) -> Column:
    """A digest as hex digits: the seeded order of keys, the same for every run and for added rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def cuts(df: DataFrame, groups: list[str], wanted: list[tuple]) -> dict[tuple, str | None]:
    """For each of ``wanted``, values of the columns ``groups`` and a rank k from 0: the k-th smallest value of the
    column ``order`` within that group, or None where the group ends before. A round counts by leading digits within the groups asked for,
    until few enough rows begin like the one looked for."""
    spark, out = df.sparkSession, {}
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in groups)
    open_ = [(w, "", w[-1]) for w in wanted]
    width = 0
    while open_:
        begun = sorted({(*w[:-1], start) for w, start, _ in open_}, key=str)
        table = F.broadcast(spark.createDataFrame(begun, f"{kinds}{', ' if kinds else ''}start string"))
        own = df.withColumn("start", F.substring("order", 1, width)).join(table, [*groups, "start"])
        counts: dict[tuple, list] = {}
        for r in own.groupBy(*groups, "start", F.substring("order", width + 1, _DIGITS).alias("next")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault((*[r[c] for c in groups], r.start), []).append((r.next, r.n))
        going, small = [], []
        for w, start, k in open_:
            for digits, n in sorted(counts.get((*w[:-1], start), [])):
                if k < n:
                    (small if n <= _FEW or not digits else going).append((w, start + digits, k))
                    break
                k -= n
            else:
                out[w] = None
        width += _DIGITS
        if small:
            ends = sorted({(*w[:-1], start) for w, start, _ in small}, key=str)
            table = F.broadcast(spark.createDataFrame(ends, f"{kinds}{', ' if kinds else ''}start string"))
            rows: dict[tuple, list] = {}
            for r in df.withColumn("start", F.substring("order", 1, width)).join(table, [*groups, "start"]).groupBy(*groups, "start", "order").agg(F.count(F.lit(1)).alias("n")).collect():
                rows.setdefault((*[r[c] for c in groups], r.start), []).append((r.order, r.n))
            for w, start, k in small:
                for order, n in sorted(rows[(*w[:-1], start)]):
                    if k < n:
                        out[w] = order
                        break
                    k -= n
        open_ = going
    return out


def exact_split(df: DataFrame, key: str, fractions=None, seed: int = SEED) -> DataFrame:
    """Split by the order of a digest of the key: train and train + valid are ``int`` of their fractions times n, as in the random
    split, where keys are unique; rows of one key stay together. No row moves, none goes to the driver but few at a cut."""
    train, valid, _ = check_fractions(fractions)
    named = df.withColumn("order", F.coalesce(_order(key, seed), F.lit("")))
    n = df.count()
    ends = {k: int(x * n) for k, x in (("train", train), ("valid", train + valid))}
    at = cuts(named.select("order"), [], sorted({(k,) for k in ends.values()}))
    below = lambda k: F.lit(True) if at[(ends[k],)] is None else F.col("order") < at[(ends[k],)]
    return named.drop("split").withColumn("split", F.when(below("train"), "train").when(below("valid"), "valid").otherwise("test")).drop("order")


def shares(sizes: dict[int, int], fractions=None) -> dict[int, tuple[int, int]]:
    """How many groups of each size go to train and how many to valid, given the number of groups by size. The walk from the
    largest on is the one group by group: of one size, those that fit come first, since nothing fits better after one that didn't."""
    train, valid, _ = check_fractions(fractions)
    total = sum(size * n for size, n in sizes.items())
    most_train, most_both = train * total, (train + valid) * total
    out, in_train, in_both = {}, 0, 0

    def fitting(room: float, size: int, n: int, held: int) -> int:
        fit = max(0, min(n, int((room - held) // size)))
        while fit < n and held + (fit + 1) * size <= room:
            fit += 1
        while fit and held + fit * size > room:
            fit -= 1
        return fit

    for size in sorted(sizes, reverse=True):
        first = fitting(most_train, size, sizes[size], in_train)
        in_train, in_both = in_train + first * size, in_both + first * size
        second = fitting(most_both, size, sizes[size] - first, in_both)
        in_both += second * size
        out[size] = (first, second)
    return out


def hashed_group_split(df: DataFrame, group: str, fractions=None, seed: int = SEED) -> DataFrame:
    """Whole groups to sides, by the greedy walk of the group split over groups in a seeded order by digest (null is a group).
    The driver gets the number of groups of each size and says how many of each go where; which ones follows from cuts of the
    order within a size. For any number of groups."""
    found = written(df.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("size")).withColumn("order", F.coalesce(_order("__group", seed), F.lit(""))), "groups")
    sizes = {r["size"]: r.n for r in found.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each size
    parts = shares(sizes, fractions)
    inner = sorted({(size, k) for size, (x, y) in parts.items() for k in (x, x + y) if 0 < k < sizes[size]})
    at = cuts(found.select("size", "order"), ["size"], inner)
    ends = [(size, *[("" if k == 0 else at.get((size, k))) for k in (x, x + y)]) for size, (x, y) in parts.items()]
    table = F.broadcast(df.sparkSession.createDataFrame(ends, "size long, first string, second string"))
    below = lambda c: F.col(c).isNull() | (F.col("order") < F.col(c))
    sided = found.join(table, "size").select("__group", F.when(below("first"), "train").when(below("second"), "valid").otherwise("test").alias("split"))
    return df.drop("split").join(sided, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def assign_groups(sizes: list[int], fractions=None, seed: int = SEED) -> list[str]:
    """Sides of groups given in order of first appearance: shuffled, then largest first; a group goes to train if it
    fits, else to valid if train and valid together stay within theirs, else to test. The cuts are not rounded."""
    train, valid, _ = check_fractions(fractions)
    total = sum(sizes)
    most_train, most_both = train * total, (train + valid) * total
    order = np.arange(len(sizes))
    np.random.RandomState(seed).shuffle(order)
    filled = [0, 0]
    out = [""] * len(sizes)
    for g in sorted(order.tolist(), key=lambda g: -sizes[g]):
        if filled[0] + sizes[g] <= most_train:
            out[g] = "train"
            filled[0] += sizes[g]
        elif sum(filled) + sizes[g] <= most_both:
            out[g] = "valid"
            filled[1] += sizes[g]
        else:
            out[g] = "test"
    return out


def group_sizes(df: DataFrame, group: str, row_id: str = "row_id") -> DataFrame:
    """Groups (null is one) with their size, by first appearance."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first"))


def group_split(df: DataFrame, group: str, fractions=None, seed: int = SEED, row_id: str = "row_id") -> DataFrame:
    """Whole groups to sides. The greedy walk is sequential over groups: two numbers for each go to the driver, its size and
    its first row, which is its name there."""
    found = group_sizes(df, group, row_id)
    rows = sorted((r["first"], r.n) for r in found.select("first", "n").collect())
    sides = [(first, side) for (first, _), side in zip(rows, assign_groups([n for _, n in rows], fractions, seed), strict=True)]
    named = found.join(df.sparkSession.createDataFrame(sides, "first long, split string"), "first").select(F.col(group).alias("__group"), "split")
    return df.drop("split").join(named, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


SPLITTERS = {"random": random_split, "rand": random_split, "scaffold": group_split, "scaffold_split": group_split, "exact": exact_split, "hashed_groups": hashed_group_split}


def splitter(name: str):
    key = str(name or "random").strip().lower()
    if key not in SPLITTERS:
        raise ValueError(f"unknown split method: {name}")
    return SPLITTERS[key]
