"""Pairs of similar entities whose labels differ.

Similar pairs are found among distinct entities and expanded to records afterwards. Within train and valid, or within
test, equal entities are no pair (they are conflicts); across, they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.functions.labels import classification_delta, exceeds, regression_delta
from splitlens.functions.similarity import tanimoto
from splitlens.operators import blocks
from splitlens.operators.similarity import MEASURES, consensus_pairs, fitting_cells, way_of
from splitlens.session import written

COLUMNS = ("entity", "split", "row_id", "id", "label_num", "label_key")
PART, ROWS = blocks.PRODUCT, 1 << 16  # pairs that are compared at once, rows that are handed on at once


def distinct_entities(records: DataFrame) -> DataFrame:
    """One row per entity that isn't null: ``text``, its bits, and an id that follows from the text."""
    columns = [c if c in records.columns else F.lit(None).cast("array<int>").alias(c) for c in ("fp", "frame")]
    found = records.where("entity is not null").select("entity", *columns).groupBy("entity").agg(F.first("fp").alias("fp"), F.first("frame").alias("frame"))
    return found.select(F.col("entity").alias("id"), F.col("entity").alias("text"), "fp", "frame")


def _with_bits(records: DataFrame) -> DataFrame:
    """Entities that have bits or framework bits."""
    return distinct_entities(records).where("fp is not null or frame is not null").select(F.col("id").alias("entity"))


def _scan(records: DataFrame, threshold: float, task: str, sigma3: list[float], columns: tuple[str, ...]) -> DataFrame | None:
    """``cliff_rows`` by bits alone: records are compared as rows of bit matrices, block by block, and a task yields finished pairs,
    so that nothing but blocks is shuffled. None where sets are joined better by prefixes or entities are fewer than half of the records."""
    spark, bits = records.sparkSession, distinct_entities(records).where("fp is not null").select(F.col("id").alias("entity"), F.col("fp").alias("bits"), F.size("fp").alias("size"))
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    carried = tuple(dict.fromkeys(("entity", "row_id", "label_num", *columns)))
    known = records.where("split is not null").select(*carried, order.alias("order"), (F.col("split") == "test").alias("test"), F.to_json("label_key").alias("label"))
    own = written(known.join(bits, "entity").withColumn("id_", F.xxhash64("order", "row_id", "entity")), "cliff-records")
    sets = own.select(F.col("id_").alias("id"), "bits", "size")
    n, n_entities = own.agg(F.count(F.lit(1)), F.countDistinct("entity")).first()
    if not n or n > 2 * n_entities or threshold > 1:
        return None
    way, sizes, n_bits = way_of(own.select(F.col("entity").alias("id"), "bits", "size").dropDuplicates(["id"]), threshold)
    if way != "scan":
        return None
    sizes, n_bits = blocks.histogram(sets)
    made = blocks.blocks_of(sizes, n_bits, spark.sparkContext.defaultParallelism)
    more = (*[c for c in carried if c != "id"], "order", "test", "label", *(["id_own"] if "id" in carried else []))
    renamed = own.withColumnRenamed("id", "id_own") if "id" in carried else own
    packed = written(blocks.packed(renamed.withColumnRenamed("id_", "id"), made, n_bits, more), "packed-records")
    given = [(c, "id_own" if c == "id" else c) for c in dict.fromkeys((*columns, "label_num"))]
    kinds = {c: records.schema[c].dataType.simpleString() for c, _ in given}
    schema = "kind int, tanimoto double" + "".join(f", {c}_A {kinds[c]}, {c}_B {kinds[c]}" for c, _ in given)
    classes = task == "classification"

    def compare(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = blocks.Rows.of(left, n_bits), blocks.Rows.of(right, n_bits)
        within = left["i"][0] == left["j"][0]
        flat = {c: pa.concat_arrays([t[c].combine_chunks().flatten() for t in (left, right)]) for c in more}
        code = lambda x: x.dictionary_encode().indices.fill_null(-1).to_numpy()
        entity, test = code(flat["entity"]), flat["test"].to_numpy(zero_copy_only=False).astype(bool)
        place = np.empty(len(entity), np.int64)
        keys = ["order", "row_id", "entity"]
        place[pc.sort_indices(pa.table({c: flat[c] for c in keys}), [(c, "ascending") for c in keys], null_placement="at_start").to_numpy()] = np.arange(len(entity))
        if classes:
            label = code(flat["label"])
        else:
            nums = flat["label_num"]
            lengths = nums.value_lengths().fill_null(0).to_numpy()
            number = np.full((len(nums), max(1, int(lengths.max(initial=0)))), np.nan)
            number[np.arange(number.shape[1]) < lengths[:, None]] = nums.flatten().to_numpy(zero_copy_only=False)
            least = np.array([sigma3[min(i, len(sigma3) - 1)] for i in range(number.shape[1])])
        waiting: list[list[np.ndarray]] = []

        def rows(x: np.ndarray, y: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
            swap = np.where(test[x] == test[y], place[x] > place[y], test[x])
            one, other = pa.array(np.where(swap, y, x)), pa.array(np.where(swap, x, y))
            kind = np.where(test[x] != test[y], 2, test[x].astype(np.int32)).astype(np.int32)
            arrays = {"kind": pa.array(kind), "tanimoto": pa.array(similarity)}
            for c, name in given:
                arrays |= {f"{c}_A": flat[name].take(one), f"{c}_B": flat[name].take(other)}
            return pa.RecordBatch.from_pydict(arrays)

        share = threshold / (1 + threshold)
        low, high = (a.sizes * share - 0.01).astype(np.float32), (b.sizes * share).astype(np.float32)
        for at, both in blocks.products(a, b, n_bits, PART):
            x, y = np.divmod(np.flatnonzero(both >= low[:, None] + high[at : at + both.shape[1]]), both.shape[1])
            shared = both[x, y].astype(np.float64)
            either = a.sizes[x] + b.sizes[y + at] - shared
            similarity = np.where(either == 0, 1.0, shared / np.maximum(either, 1))
            y = y + at
            keep = (similarity >= threshold) & (not within or x < y)  # a pair within a block is met from both sides
            x, y, similarity = x[keep], y[keep] + len(a.ids), similarity[keep]
            keep = (entity[x] != entity[y]) | (test[x] != test[y])
            if classes:
                keep &= (label[x] != label[y]) & (label[x] >= 0) & (label[y] >= 0)
            else:
                with np.errstate(invalid="ignore"):
                    apart = ~(np.abs(number[x] - number[y]) < least) & (least != 0)
                keep &= apart.any(1)  # no number, or endless ones: the exact test follows
            waiting.append([x[keep], y[keep], similarity[keep]])
            if sum(len(w[0]) for w in waiting) >= ROWS:
                found = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                waiting.clear()
                for k in range(0, len(found[0]), ROWS):
                    yield rows(*[c[k : k + ROWS] for c in found])
        found = [np.concatenate(c) for c in zip(*waiting, strict=True)] if waiting else []
        if found and len(found[0]):
            yield rows(*found)

    pairs = blocks.meet_in_parts(packed, fitting_cells(spark, made, threshold), compare, schema)
    none = F.lit(None).cast("double")
    kind = F.when(F.col("kind") == 2, "cross_tv_test").when(F.col("kind") == 1, "intra_test").otherwise("intra_tv")
    delta = (classification_delta if classes else regression_delta)(F.col("label_num_A"), F.col("label_num_B"))
    out = pairs.select("tanimoto", none.alias("scaffold_tanimoto"), none.alias("string_ratio"), *[f"{c}_{n}" for n in "AB" for c, _ in given], kind.alias("kind"), delta.alias("delta"))
    if not classes:
        out = out.where(exceeds(F.col("delta"), F.array(*[F.lit(float(x)) for x in sigma3])))
    return out.select("tanimoto", "scaffold_tanimoto", "string_ratio", *[f"{c}_{n}" for n in "AB" for c in columns], "kind", "delta")


def cliff_rows(
    records: DataFrame, threshold: float, task: str, sigma3: list[float] | None = None, measures: tuple[str, ...] = MEASURES, columns: tuple[str, ...] = COLUMNS
) -> DataFrame:
    """``kind`` (intra_tv, intra_test, cross_tv_test), both records (``columns`` of them), the three similarities and ``delta``.
    Similarities that ``measures`` leaves out are null."""
    if "fp" in measures and "text" not in measures and "fp" in records.columns and ("frame" not in measures or "frame" not in records.columns):
        found = _scan(records, threshold, task, sigma3 or [0.0], columns)
        if found is not None:
            return found
    pairs = consensus_pairs(distinct_entities(records), threshold, measures)
    scores = ["tanimoto", "scaffold_tanimoto", "string_ratio"]
    both = pairs.select("a", "b", *scores).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *scores))
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("array<int>")
    alone = records.where("entity is not null").groupBy("entity").agg(F.first(has("fp")).alias("fp"), F.first(has("frame")).alias("frame"), F.bit_or(F.when(F.col("split") == "test", 2).otherwise(1)).alias("sides"))
    same = alone.where("sides = 3 and (fp is not null or frame is not null)").select(
        F.col("entity").alias("a"), F.col("entity").alias("b"), tanimoto(F.col("fp"), F.col("fp")).alias("tanimoto"), tanimoto(F.col("frame"), F.col("frame")).alias("scaffold_tanimoto"), F.lit(1.0 if "text" in measures else None).cast("double").alias("string_ratio")
    )
    wanted = both.unionByName(same)
    side = lambda n: records.select(*[F.col(c).alias(f"{c}_{n}") for c in ("entity", "split", "row_id", "id", "label_num", "label_key")])
    a, b = side("A"), side("B")
    joined = wanted.join(a, F.col("a") == F.col("entity_A")).join(b, F.col("b") == F.col("entity_B"))
    test_a, test_b = F.col("split_A") == "test", F.col("split_B") == "test"
    rank = lambda n: F.struct(F.when(F.col(f"split_{n}") == "train", 0).when(F.col(f"split_{n}") == "valid", 1).otherwise(2), F.col(f"row_id_{n}"), F.col(f"entity_{n}"))
    ordered = (rank("A") < rank("B")) & (F.col("a") != F.col("b"))
    kind = F.when(~test_a & test_b, "cross_tv_test").when(~test_a & ~test_b & ordered, "intra_tv").when(test_a & test_b & ordered, "intra_test")
    joined = joined.withColumn("kind", kind).where("kind is not null")
    if task == "classification":
        joined = joined.where("label_key_A != label_key_B").withColumn("delta", classification_delta(F.col("label_num_A"), F.col("label_num_B")))
    else:
        joined = joined.withColumn("delta", regression_delta(F.col("label_num_A"), F.col("label_num_B")))
        joined = joined.where(exceeds(F.col("delta"), F.array(*[F.lit(float(x)) for x in sigma3 or [0.0]])))
    return joined.select(*scores, *[f"{c}_{n}" for n in "AB" for c in columns], "kind", "delta")


def cliff_counts(records: DataFrame, threshold: float, task: str, sigma3: list[float] | None = None, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """``kind`` and ``n``, the number of its ``cliff_rows``; a kind without rows is left out.

    No records are paired. They are counted by entity, side and label, and pairs of entities multiply these counts: for classes, all
    pairs of records less those of equal labels, so no label meets another one; for numbers, labels meet labels."""
    own = records.where("entity is not null and split is not null").withColumn("test", F.col("split") == "test")
    label = "label_key" if task == "classification" else "label_num"
    counts = written(own.where(F.col(label).isNotNull()).groupBy("entity", "test", label).agg(F.count(F.lit(1)).alias("n")), "label-counts")
    same = counts.groupBy("entity").agg(F.bool_or("test").alias("t"), F.bool_or(~F.col("test")).alias("tv")).where("t and tv")
    known = _with_bits(records).select(F.col("entity").alias("__entity"))
    same = same.join(known, F.col("entity") == F.col("__entity"), "left_semi").select(F.col("entity").alias("a"), F.col("entity").alias("b"))
    pairs = written(consensus_pairs(written(distinct_entities(records), "entities"), threshold, measures).select("a", "b").unionByName(same), "similar-entities")
    side = lambda of, x, *more: of.select(*[F.col(c).alias(f"{c}_{x}") for c in ("entity", "test", "n", *more)])
    kind = F.when(F.col("test_A") != F.col("test_B"), "cross_tv_test").when(F.col("a") != F.col("b"), F.when(F.col("test_A"), "intra_test").otherwise("intra_tv"))
    twice = (F.col("a") == F.col("b")) & F.col("test_A")  # an entity meets itself across once

    def met(of: DataFrame, alike: Column | None = None, *more: str) -> DataFrame:
        on = F.col("b") == F.col("entity_B")
        both = pairs.join(side(of, "A", *more), F.col("a") == F.col("entity_A")).join(side(of, "B", *more), on if alike is None else on & alike)
        return both.where(~twice).withColumn("kind", kind).where("kind is not null").withColumn("n", F.col("n_A") * F.col("n_B"))

    if task == "classification":
        every = met(counts.groupBy("entity", "test").agg(F.sum("n").alias("n"))).select("kind", "n")
        equal = met(counts, F.col("label_key_A") == F.col("label_key_B"), "label_key").select("kind", (-F.col("n")).alias("n"))
        found = every.unionByName(equal)
    else:
        far = exceeds(regression_delta(F.col("label_num_A"), F.col("label_num_B")), F.array(*[F.lit(float(x)) for x in sigma3 or [0.0]]))
        found = met(counts, None, "label_num").where(far).select("kind", "n")
    return found.groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")
