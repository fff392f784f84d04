"""Exact similarity joins: prefix filters where features are sparse, packed block scans where they are dense.

A prefix filter emits, for each item, the rarest features that two similar items must share one of, joins
items on them, and drops pairs that sizes rule out; then similarity is computed once per pair. Where the features of a
small domain stand in many sets, that join would make most pairs, each many times over. The counts of the features say so
beforehand; then sets are compared as rows of bit matrices, block by block (``blocks``), of which only those of fitting
sizes meet, and nothing but the result is emitted. Both give the same pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlens.functions.similarity import indel_ratio, tanimoto
from splitlens.operators import blocks
from splitlens.session import written

EPSILON = 1e-9
MOST_BITS = 1 << 14  # of a domain that is scanned
_MADE, _COMPARED = 1e-6, 1e-10  # seconds: for a pair that a join makes, for a bit of a pair that is compared
LONG = 32  # strings above this are joined on longer grams
SEGMENTED = 0.8  # from this threshold on, segments of shorter strings have two letters or more


def _ranked(items: DataFrame) -> DataFrame:
    """``id``, ``size``, ``feature`` in; adds ``rank``, from 1, rarest feature first."""
    counts = items.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    return items.join(counts, "feature").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "feature")))


def _meeting(prefixes: DataFrame, fits: Column) -> DataFrame:
    """Pairs ``a`` < ``b`` of ids that share a prefix feature and fit in size (``sa``, ``sb``)."""
    left = prefixes.select("feature", F.col("id").alias("a"), F.col("size").alias("sa"))
    right = prefixes.select("feature", F.col("id").alias("b"), F.col("size").alias("sb"))
    return left.join(right, "feature").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def _prefixes(sized: DataFrame, threshold: float) -> DataFrame:
    """``id``, ``size``, ``feature``: sets of size s share at least ``threshold * s`` elements with a similar one, so one
    among the s - ceil(threshold * s) + 1 rarest. Empty sets equal each other and nothing else: they share a feature."""
    each = sized.select("id", "size", F.explode(F.when(F.col("size") == 0, F.array(F.lit(-1))).otherwise(F.col("bits"))).alias("feature"))
    return _ranked(each).where(F.col("rank") <= F.col("size") - F.ceil(threshold * F.col("size") - EPSILON) + 1)


def _by_prefixes(sized: DataFrame, prefixes: DataFrame, threshold: float) -> DataFrame:
    pairs = _meeting(prefixes, F.least("sa", "sb") >= threshold * F.greatest("sa", "sb") - EPSILON)
    a, b = sized.select(F.col("id").alias("a"), F.col("bits").alias("x")), sized.select(F.col("id").alias("b"), F.col("bits").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", tanimoto(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold)


def fitting_cells(spark, made: list[blocks.Block], threshold: float) -> DataFrame:
    """Each block with those up to itself whose sizes allow the threshold."""
    first = lambda b: next(a.no for a in made if a.alike(b) >= threshold - EPSILON)
    return blocks.cells_of(spark, [(b.no, [range(first(b), b.no + 1)]) for b in made])


def _by_scan(sized: DataFrame, sizes: dict[int, int], n_bits: int, threshold: float) -> DataFrame:
    """Blocks of sets meet the blocks of sets that aren't larger, nor too small."""
    spark, kind = sized.sparkSession, sized.schema["id"].dataType.simpleString()
    made = blocks.blocks_of(sizes, n_bits, spark.sparkContext.defaultParallelism)
    own = written(blocks.packed(sized, made, n_bits), "packed-sets")
    cells = fitting_cells(spark, made, threshold)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = blocks.Rows.of(left, n_bits), blocks.Rows.of(right, n_bits)
        within, parts = left["i"][0] == left["j"][0], []
        for at, both in blocks.products(a, b, n_bits):
            all_ = a.sizes[:, None] + b.sizes[None, at : at + both.shape[1]]
            x, y = np.nonzero(both >= threshold * (all_ - both) - EPSILON)
            shares, either = both[x, y].astype(np.float64), (all_[x, y] - both[x, y]).astype(np.float64)
            similarity, y = np.where(either == 0, 1.0, shares / np.maximum(either, 1)), y + at
            keep = (similarity >= threshold) & (not within or x < y)  # a pair within a block is met from both sides
            one, other = a.ids.take(pa.array(x[keep])), b.ids.take(pa.array(y[keep]))
            ordered = pc.less(one, other)
            parts.append(pa.table({"a": pc.if_else(ordered, one, other), "b": pc.if_else(ordered, other, one), "similarity": pa.array(similarity[keep])}))
        return pa.concat_tables(parts)

    return blocks.meet(own, own, cells, compare, f"a {kind}, b {kind}, similarity double")


def tanimoto_pairs(sets: DataFrame, threshold: float, way: str | None = None) -> DataFrame:
    """``a`` < ``b`` and ``similarity``. Columns of ``sets``: ``id`` (unique), ``bits`` (distinct numbers that aren't negative;
    null takes no part). ``way`` (``prefix`` or ``scan``) overrides the choice by cost."""
    sized = sets.where("bits is not null").select("id", "bits", F.size("bits").alias("size"))
    prefixes = _prefixes(sized, threshold)
    sizes, n_bits = blocks.histogram(sized)
    way = way or by_cost(prefixes, sizes, n_bits)
    return _by_scan(sized, sizes, n_bits, threshold) if way == "scan" else _by_prefixes(sized, prefixes, threshold)


def by_cost(prefixes: DataFrame, sizes: dict[int, int], n_bits: int) -> str:
    if n_bits > MOST_BITS or not sizes:
        return "prefix"
    made = prefixes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    n = sum(sizes.values())
    return "prefix" if made / 2 * _MADE <= n * n / 2 * n_bits * _COMPARED else "scan"


def way_of(sized: DataFrame, threshold: float) -> tuple[str, dict[int, int], int]:
    """The way that counts choose for ``sized`` (``id``, ``bits``, ``size``), with the histogram of sizes and the domain."""
    sizes, n_bits = blocks.histogram(sized)
    return by_cost(_prefixes(sized, threshold), sizes, n_bits), sizes, n_bits


def _grams(text: Column, q: int) -> Column:
    """Each run of ``q`` characters with the number of its occurrence, so that a multiset is a set."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - q + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(q)))
    return grams


def string_candidates(strings: DataFrame, threshold: float, way: str | None = None) -> DataFrame:
    """Pairs of ids whose strings (``text``) may have an indel ratio of ``threshold`` or more.

    Such strings keep a common subsequence of threshold * (la + lb) / 2, hence share that many characters as
    multisets, and la * t / (2 - t) at least whatever the partner's length. From ``SEGMENTED`` on, short strings are joined on
    letters or on ``segments`` of letters, whichever makes fewer pairs by the counts of their keys (``way`` overrides that);
    long ones are joined on runs of q characters, of which each of the at most 2 * la * (1 - t) / t edits breaks q."""
    t = threshold
    longest_partner = (2 - t) / t if t > 0 else math.inf
    edits = 2 * (1 - t) / t if t > 0 else math.inf
    q = next((x for x in (4, 3, 2) if x * edits < 0.75), 1)
    sized = strings.select("id", "text", F.length("text").alias("size")).where("text is not null and size > 0")
    fits = F.least("sa", "sb") * 2 >= t * (F.col("sa") + F.col("sb")) - EPSILON

    def letters(part: DataFrame) -> DataFrame:
        return _ranked(numbered(part, 1)).where(F.col("rank") <= F.col("size") - F.ceil(t * F.col("size") / (2 - t) - EPSILON) + 1)

    def lettered(part: DataFrame) -> DataFrame:
        return _meeting(letters(part), fits)

    def numbered(part: DataFrame, n: int) -> DataFrame:
        each = part.select("id", "size", F.posexplode(_grams(F.col("text"), n)).alias("pos", "gram"))
        occurrence = F.row_number().over(Window.partitionBy("id", "gram").orderBy("pos"))
        return each.withColumn("feature", F.struct("gram", occurrence.alias("n"))).select("id", "size", "feature")

    short, long_ = sized.where(F.col("size") <= math.floor(LONG * longest_partner)), sized.where(F.col("size") > LONG)
    if t < SEGMENTED:
        if q == 1:
            return lettered(sized)
        found = lettered(short)
    else:
        left, right = _segments(short, t)
        if way is None:
            key = ["n", "no", "letters"]
            of = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("k"))
            segmented = of(left, *key).join(of(right, *key).withColumnRenamed("k", "o"), key).agg(F.sum(F.col("k") * F.col("o"))).first()[0] or 0.0
            way = "segments" if segmented <= (of(letters(short), "feature").agg(F.sum(F.col("k") * F.col("k") / 2)).first()[0] or 0.0) else "letters"
        found = _meeting_segments(left, right) if way == "segments" else lettered(short)
    if q == 1:
        rest = lettered(long_)
    else:
        by_gram = _ranked(numbered(long_, q)).where(F.col("rank") <= q * F.floor(edits * F.col("size") + EPSILON) + 1)
        rest = _meeting(by_gram, fits)
    return found.unionByName(rest).distinct()


def _segments(sized: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """What strings have and what they ask for, so that similar ones meet by pigeonhole. The shorter string of a pair, of length n, is cut evenly into one segment more than the
    edits that any partner can be away. The first segment up to whose end there are no more edits than segments before it is
    unharmed: it stands in the longer string, at most as far from its place as there are edits before it, and as the
    edits behind it allow. So strings meet on length, segment number and its letters."""

    def edits(short: Column, long_: Column) -> Column:
        return F.floor((1 - t) * (short + long_) + EPSILON).cast("int")

    def pieces(n: Column) -> Column:
        return edits(n, F.floor(n * (2 - t) / t + EPSILON)) + 1

    def start(n: Column, i: Column) -> Column:
        m = pieces(n)
        return (i * F.floor(n / m) + F.greatest(F.lit(0), i - (m - n % m))).cast("int")

    n = F.col("size")
    own = F.transform(F.sequence(F.lit(0), pieces(n) - 1), lambda i: F.struct(i.alias("no"), F.substring("text", start(n, i) + 1, start(n, i + 1) - start(n, i)).alias("letters")))
    left = sized.select(F.col("id").alias("x"), n.alias("n"), F.explode(own).alias("s")).select("x", "n", "s.no", "s.letters")
    shorter = F.sequence(F.ceil(n * t / (2 - t) - EPSILON).cast("int"), n)
    each = sized.select("id", "text", "size", F.explode(shorter).alias("n"))
    short, more = F.col("n"), F.col("size") - F.col("n")
    most, m = edits(short, F.col("size")), pieces(short)

    def asked(i: Column) -> Column:
        at, length = start(short, i), start(short, i + 1) - start(short, i)
        low = F.greatest(-i, more - (m - 1 - i), -F.floor((most - more) / 2).cast("int"), -at)
        high = F.least(i, more + (m - 1 - i), F.floor((most + more) / 2).cast("int"), F.col("size") - length - at)
        shifts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(shifts, lambda d: F.struct(i.alias("no"), F.substring("text", at + d + 1, length).alias("letters"))))

    probes = F.flatten(F.transform(F.sequence(F.lit(0), m - 1), asked))
    right = each.where(more <= most).select(F.col("id").alias("y"), "n", F.explode(probes).alias("s")).select("y", "n", "s.no", "s.letters")
    return left, right


def _meeting_segments(left: DataFrame, right: DataFrame) -> DataFrame:
    met = left.join(right, ["n", "no", "letters"]).where("x != y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def string_ratio_pairs(strings: DataFrame, threshold: float) -> DataFrame:
    """``a`` < ``b`` and ``similarity`` of distinct strings (``id``, ``text``). The JVM's edit distance, which an indel
    distance is never below, screens pairs before the exact kernel."""
    a = strings.select(F.col("id").alias("a"), F.col("text").alias("x"))
    b = strings.select(F.col("id").alias("b"), F.col("text").alias("y"))
    pairs = string_candidates(strings, threshold).join(a, "a").join(b, "b")
    most = F.floor((1 - threshold) * (F.length("x") + F.length("y")) + EPSILON).cast("int")
    near = pairs.where(F.levenshtein("x", "y") <= most)
    return near.select("a", "b", indel_ratio("x", "y").alias("similarity")).where(F.col("similarity") >= threshold)


MEASURES = ("fp", "frame", "text")


def consensus_pairs(entities: DataFrame, threshold: float, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Pairs of distinct entities that any of three measures finds similar: bits, framework bits, strings.

    Columns: ``id``, ``text``, ``fp``, ``frame`` (either may be null). A string counts only where both have bits. Pairs of the
    ``measures`` are joined as sets, then all of these are computed once; one that is left out is null."""
    own = {
        "fp": lambda: tanimoto_pairs(entities.select("id", F.col("fp").alias("bits")), threshold),
        "frame": lambda: tanimoto_pairs(entities.select("id", F.col("frame").alias("bits")), threshold),
        "text": lambda: string_candidates(entities.where("fp is not null").select("id", "text"), threshold),
    }
    parts = [own[m]().select("a", "b") for m in MEASURES if m in measures]
    pairs = reduce(DataFrame.unionByName, parts)
    pairs = pairs.distinct() if len(parts) > 1 else pairs
    side = lambda n: entities.select(F.col("id").alias(n), F.col("text").alias(f"text_{n}"), F.col("fp").alias(f"fp_{n}"), F.col("frame").alias(f"frame_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    known = F.col("fp_a").isNotNull() & F.col("fp_b").isNotNull()
    framed = F.col("frame_a").isNotNull() & F.col("frame_b").isNotNull()
    none = F.lit(None).cast("double")
    scored = both.select(
        "a", "b",
        (F.when(known, tanimoto(F.col("fp_a"), F.col("fp_b"))) if "fp" in measures else none).alias("tanimoto"),
        (F.when(framed, tanimoto(F.col("frame_a"), F.col("frame_b"))) if "frame" in measures else none).alias("scaffold_tanimoto"),
        (indel_ratio("text_a", "text_b") if "text" in measures else none).alias("string_ratio"),
        known.alias("known"),
    )
    similar = (F.col("tanimoto") >= threshold) | (F.col("scaffold_tanimoto") >= threshold) | (F.col("known") & (F.col("string_ratio") >= threshold))
    return scored.where(F.coalesce(similar, F.lit(False))).drop("known")
