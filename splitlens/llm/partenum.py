"""N-gram Jaccard join by PartEnum signatures (after Arasu, Ganti and Kaushik, 2006), and its components.

A document's set: the fingerprints of its distinct word n-grams. Sizes are cut into bands; a set belongs to
the band of its size and also to the next if a set that is similar enough could lie there. A band
partitions the feature domain by hash; two sets agree in a partition where their projections on it are the
same and not empty. With Jaccard similarity of ``t`` or more, sets of size s differ in at most
k = floor(s * (1 - t) / t) features and so in at most k partitions. Hence of the m > k partitions where a
set is not empty, at least m - k agree. A signature is a subset of partitions with the set's projections:
subsets of one partition in wide bands, of two in the band of the smallest sets. Under any one order of the
projections, j agreeing subsets of one lie among the first k + j of both sets, so only those are enumerated,
with j = 1 + s / ``SPARE``. Of the groups of sets that meet in a signature, each set then does without as many of
the largest as it shares for certain with any similar set but one: what only a common passage connects
meets no more. (A set with fewer than k + j partitions would break this; it is looked for, and the domain is
partitioned anew under another seed until there is none.)

The order puts projections of very frequent features last: a bounded list of the most frequent features
of the corpus (``FREQUENT``), counted over all of it. It is an order only; no feature is dropped. The list also tells
which signatures are hot: one that stands for features of more than ``HOT`` documents each is salted, so that its documents meet
in groups of about ``HOT``, and the least documents of these groups in one more.

Links: sets that are equal link by their fingerprint. Sets that meet in a signature are checked exactly
against the group's least document, after sizes and bit sketches have dropped pairs that can't be similar, by
a bound that holds for certain. Families, documents connected by groups, that still span several components need a second
look, since similarity is not transitive:

* up to ``BLOCK`` members are compared by sketch, pairs of one component left out;
* a larger family is joined once more by itself, under its own order of features, rarest in the family first. Of sets of sizes
  a and b at least i = ceil(t * (a + b) / (1 + t)) features are shared, so the first shared one stands among the first
  a - i + 1 of the one and b - i + 1 of the other. What all members share comes last, so members that are no links
  have no such feature in common but by chance, and work follows features and links, not pairs of members.

Pairs that may be similar are checked exactly. So no link between components is lost and no group is expanded into pairs.

Defined results: a null text, or one without words, has an empty set and no link; fewer words than ``n``
make one feature; rows of one id are one document, each with its own size; a row without id has no
component (null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlens.llm.bloom_cascade import build_level
from splitlens.llm.common import chosen, column, flat, lean, place, release, saved
from splitlens.llm.components import components
from splitlens.llm.textscan import LOWER, WHITESPACE, Slice, Spans, mix, scan, windows

N, PERCENT = 5, 75
FREQUENT = 1 << 16
#: Largest size of each band, partitions of the domain (None: each feature is one), subset size.
BANDS = [(14, None, 2), (64, None, 1), *((64 * 4**i, 64 * 4**i, 1) for i in range(1, 20))]
SPARE = 10  # one signature more for each so many features
_COUNT_AT = 2 << 20
BLOCK = 2048  # members of a family that are compared at once
MOST_ASKED = 8 << 20  # ids of one Bloom filter, a byte each
HOT = 4096  # documents of a feature from which its signatures are salted
_WORDS_AT = 1 << 22  # words of sketches


def feature_sets(s: Slice, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ascending distinct features of each document of a slice."""
    spans = Spans(s.hashes)
    first, doc = windows(s, n)
    features = spans(first, first + n)
    cuts = np.searchsorted(doc, np.arange(len(s) + 1))
    for d in range(len(s)):
        own = features[cuts[d] : cuts[d + 1]]
        if not len(own) and s.bounds[d + 1] > s.bounds[d]:
            own = spans(s.bounds[d : d + 1], s.bounds[d + 1 : d + 2])
        yield s.row + d, np.unique(own)


def different(size: int, percent: int) -> int:
    """Most features by which a set of this size and a similar one differ."""
    return size * (100 - percent) // percent


def prefix_length(size: int, band: int, percent: int) -> int:
    """Projections from which signatures are made."""
    subset = BANDS[band][2]
    return different(size, percent) + subset + (size // SPARE if subset == 1 else 0)


def bands_of(size: int, percent: int) -> list[int]:
    own = next(i for i, b in enumerate(BANDS) if size <= b[0])
    return [own, own + 1] if size * 100 >= percent * (BANDS[own][0] + 1) else [own]


def projections(features: np.ndarray, band: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the features of each partition begin, and the fingerprint of the projection on each. Features
    are dealt by their own order, so a partition is a run."""
    parts = BANDS[band][1]
    mixed = mix(features + np.uint64(2 * seed + 1))
    if parts is None:
        return np.arange(len(features)), mix(mixed + np.uint64(band))
    ranked, place = dealt(features, seed, parts)
    starts = np.flatnonzero(np.diff(place, prepend=np.uint64(1 << 63)))
    return starts, mix(np.add.reduceat(mixed if ranked is None else mixed[ranked], starts) + np.uint64(band))


def dealt(features: np.ndarray, seed: int, parts: int) -> tuple[np.ndarray | None, np.ndarray]:
    """The order of the features by partition (None: as they are) and their partitions in it."""
    if not seed:  # features are hashes and ascend
        return None, ((features >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = mix(features ^ np.uint64(0x5851F42D4C957F2D * seed % (1 << 64)))
    ranked = np.argsort(order)
    return ranked, ((order[ranked] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def sketch(features: np.ndarray) -> np.ndarray:
    """A bit for each of the least power of two (64 at least) that is four times the size, set where a feature falls.
    Where only one of two sets has a bit, they differ in a feature, so bits that differ bound features that do."""
    bits = 64
    while bits < 4 * len(features):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[mix(features + np.uint64(12345)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def signatures(features: np.ndarray, frequent: np.ndarray, seed: int, percent: int) -> np.ndarray:
    return counted_signatures(features, frequent, np.zeros(len(frequent), np.int64), seed, percent)[0]


def counted_signatures(features: np.ndarray, frequent: np.ndarray, counts: np.ndarray, seed: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set, and of each the least count of documents of its features; 0 if one isn't listed."""
    out, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if not len(features):
        return out[0], held[0]
    at = np.minimum(np.searchsorted(frequent, features), max(0, len(frequent) - 1))
    common = frequent[at] == features if len(frequent) else np.zeros(len(features), bool)
    of = np.where(common, counts[at], 0) if len(frequent) else np.zeros(len(features), np.int64)
    for band in bands_of(len(features), percent):
        _, parts, subset = BANDS[band]
        starts, marks = projections(features, band, seed)
        if common.any():
            if parts is None:
                last, n = common, of
            else:
                ranked = dealt(features, seed, parts)[0]
                last, n = (f.reduceat(x if ranked is None else x[ranked], starts) for f, x in ((np.logical_and, common), (np.minimum, of)))
            order = np.lexsort((marks, last))[: prefix_length(len(features), band, percent)]
            first, n = marks[order], n[order]
        else:
            first = np.sort(marks)[: prefix_length(len(features), band, percent)]
            n = np.zeros(len(first), np.int64)
        if subset == 1:  # the lowest bit tells a set's two bands apart
            out.append(first & ~np.uint64(1) | np.uint64(band % 2))
            held.append(n)
        elif len(first) >= subset:
            i, j = np.triu_indices(len(first), 1)
            out.append(mix(first[i] + first[j] + np.uint64(subset)) & ~np.uint64(1))
            held.append(np.minimum(n[i], n[j]))
    return np.concatenate(out), np.concatenate(held)


def _first_pass(n: int, percent: int, seed: int):
    """A row per document (size, fingerprint of the set, whether a band has too few partitions for it), and
    counts of features that are frequent within what a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "size", "a", "b", "thin", "bits"]
        empty = np.zeros(0, np.int64)

        def rows(kind: str, *columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(columns[0]), pa.string()), *(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns)], names=names)

        def counted(seen: list[np.ndarray]) -> pa.RecordBatch:
            features, counts = np.unique(np.concatenate(seen), return_counts=True)
            own = counts >= 4
            features, counts = features[own].view(np.int64), counts[own].astype(np.int64)
            return rows("feature", features, counts, counts, counts, np.zeros(len(counts), bool), pa.array([empty] * len(counts), pa.list_(pa.int64())))

        seen, held = [], 0
        for batch in batches:
            ids = column(batch, "doc_id")
            sizes, a, b, thin = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, np.int64, bool))
            bits = [empty] * batch.num_rows
            for s in scan(column(batch, "text"), WHITESPACE, LOWER):
                for row, features in feature_sets(s, n):
                    sizes[row] = len(features)
                    if len(features):
                        bits[row] = sketch(features)
                        a[row] = np.add.reduce(mix(features)).view(np.int64)
                        b[row] = np.bitwise_xor.reduce(mix(features + np.uint64(77))).view(np.int64)
                        thin[row] = any(len(projections(features, band, seed)[0]) < prefix_length(len(features), band, percent) for band in bands_of(len(features), percent) if BANDS[band][1])
                        seen.append(features)
                        held += len(features)
                if held >= _COUNT_AT:
                    yield counted(seen)
                    seen, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(["doc"] * batch.num_rows, pa.string()), ids, *(pa.array(x) for x in (sizes, a, b, thin)), pa.array(bits, pa.list_(pa.int64()))], names=names)
        if seen:
            yield counted(seen)

    return run


SIGNED = "signature long, doc_id long, base long"


def _second_pass(n: int, percent: int, seed: int, frequent):
    """Signatures of the documents; of a hot one a salted value, which keeps the lowest bit, and ``base``, the signature itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (last, counts), copies = frequent.value, set()
        for batch in batches:
            ids = column(batch, "doc_id").to_numpy()
            for s in scan(column(batch, "text"), WHITESPACE, LOWER):
                found, held, rows = [], [], []
                for row, features in feature_sets(s, n):
                    mark = (len(features), int(np.add.reduce(features)), int(np.bitwise_xor.reduce(mix(features)))) if len(features) else None
                    if mark is None or mark in copies:
                        continue  # an equal set of this task has the signatures; equal sets link anyway
                    copies.add(mark)
                    signed, of = counted_signatures(features, last, counts, seed, percent)
                    found.append(signed)
                    held.append(of)
                    rows.append(row)
                if found:
                    base, of, docs = np.concatenate(found), np.concatenate(held), np.repeat(ids[rows], [len(x) for x in found])
                    hot = of > HOT
                    salt = mix(docs.view(np.uint64) + np.uint64(99)) % (-(-of // HOT)).astype(np.uint64).clip(1)
                    salted = np.where(hot, mix(base + mix(salt)) & ~np.uint64(1) | base & np.uint64(1), base)
                    yield pa.RecordBatch.from_arrays([pa.array(salted.view(np.int64)), pa.array(docs), pa.array(base.view(np.int64), mask=~hot)], names=["signature", "doc_id", "base"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id").to_numpy()
            for s in scan(column(batch, "text"), WHITESPACE, LOWER):
                rows, sets = zip(*feature_sets(s, n), strict=True)
                flat = np.concatenate(sets).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(rows)]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "features"])

    return run


def _most_frequent(counts: DataFrame) -> list:
    """Rows of the highest counts ``n``, at most ``FREQUENT``: whole steps of a count scale, whose sizes are counted first."""
    step = F.floor(F.log2("n") * 8)
    room, lowest = FREQUENT, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # some hundred steps
        if r["count"] > room:
            break
        room, lowest = room - r["count"], r.step
    return [] if lowest is None else counts.where(step >= lowest).collect()


def may_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow them to be similar: similar sets of sizes a and b differ in
    (a + b) * (1 - t) / (1 + t) features at most."""
    own = saved(_only(sketches, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()), "asked-sketches")
    side = lambda c: own.select(F.col("doc_id").alias(c), F.col("size").alias(f"s{c}"), F.col("bits").alias(f"b{c}"))
    both = pairs.join(side("v"), "v").where("sv > 0").join(side("u"), "u").where(f"100 * least(su, sv) >= {percent} * greatest(su, sv)")
    most = (F.col("su") + F.col("sv")) * (100 - percent) / (100 + percent)
    swap = F.size("bu") < F.size("bv")
    wide, thin = F.when(swap, F.col("bv")).otherwise(F.col("bu")), F.when(swap, F.col("bu")).otherwise(F.col("bv"))
    n = F.size("thin")
    folded = F.when(F.size("wide") == n, F.col("wide")).otherwise(F.zip_with(F.slice("wide", F.lit(1), n), F.slice("wide", n + 1, n), lambda x, y: x.bitwiseOR(y)))
    apart = F.aggregate(F.zip_with("folded", "thin", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    both = both.select("u", "v", most.alias("most"), wide.alias("wide"), thin.alias("thin")).withColumn("folded", folded)
    return both.where((F.size("wide") > 2 * n) | (apart <= F.col("most"))).select("u", "v").distinct()


def _near_in_family(percent: int):
    """Pairs of different components whose sizes and sketches allow them to be similar, among the members of a family."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, component, size = (table[c].to_numpy() for c in ("doc_id", "component", "size"))
        lists = table["bits"].chunk(0)
        words, flat, offsets = lists.value_lengths().to_numpy(), lists.values.to_numpy(), lists.offsets.to_numpy()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(words).tolist():
            rows = {w: np.flatnonzero(words == w) for w in (width, 2 * width)}
            bits = {w: flat[offsets[r][:, None] + np.arange(w)].view(np.uint64) for w, r in rows.items()}
            bits[2 * width] = bits[2 * width][:, :width] | bits[2 * width][:, width:]
            for wide in (width, 2 * width):  # sets of similar sizes have sketches of one width, or of two and one
                other = rows[width]
                step = max(1, _WORDS_AT // max(1, len(other) * width))
                for at in range(0, len(rows[wide]), step):
                    part = rows[wide][at : at + step]
                    apart = np.bitwise_count(bits[wide][at : at + step][:, None, :] ^ bits[width][None, :, :]).sum(2, dtype=np.int64)
                    a, b = size[part][:, None], size[other][None, :]
                    may = (apart * (100 + percent) <= (a + b) * (100 - percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (component[part][:, None] != component[other][None, :])
                    x, y = np.nonzero(may)
                    out.append((part[x], other[y]))
        x, y = (np.concatenate(z) for z in zip(*out, strict=True))
        u, v = np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])
        return pa.table({"u": pa.array(u[u != v]), "v": pa.array(v[u != v])})

    return run


def _near_in_large(members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The same for families of any size (``family``, ``doc_id``, ``component``), by a join on each family's rarest features.
    What is shuffled for each feature is no more than its family and document; the rest joins those that are left."""
    sets = _only(docs, members.select("doc_id").distinct()).mapInArrow(lean(_sets(n)), "doc_id long, features array<long>")
    sets = saved(sets.dropDuplicates(["doc_id"]).join(members, "doc_id").select("family", "doc_id", "component", "features"), "family-sets")
    release(docs.sparkSession)
    each = sets.select("family", "doc_id", F.explode("features").alias("feature"))
    counts = each.groupBy("family", "feature").agg(F.count(F.lit(1)).alias("df")).where("df > 1")  # a feature of one document joins none
    counts = saved(counts, "family-counts")  # read again, a join of it can be split where a feature is hot
    rarest = Window.partitionBy("doc_id").orderBy("df", "feature")
    # features of one document only come first: how many they are is known from the size
    ranked = each.join(counts, ["family", "feature"]).withColumn("back", F.count(F.lit(1)).over(Window.partitionBy("doc_id")) - F.row_number().over(rarest))
    ranked = ranked.select("family", "feature", "doc_id", "back").join(sets.select("doc_id", "component", F.size("features").alias("size")), "doc_id")
    ranked = ranked.select("family", "feature", "doc_id", "component", "size", (F.col("size") - F.col("back")).alias("rank"))
    prefix = saved(ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1), "family-prefixes")
    release(docs.sparkSession)
    across = prefix.groupBy("family", "feature").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("family", "feature")
    prefix = saved(prefix.join(saved(across, "family-across"), ["family", "feature"]), "family-meeting")
    side = lambda c: prefix.select("family", "feature", F.col("doc_id").alias(c), F.col("component").alias(f"c{c}"), F.col("size").alias(f"s{c}"), F.col("rank").alias(f"r{c}"))
    shared = F.ceil((F.col("su") + F.col("sv")) * percent / (100 + percent))
    fits = (F.col("cu") != F.col("cv")) & (F.col("u") > F.col("v")) & (F.col("ru") <= F.col("su") - shared + 1) & (F.col("rv") <= F.col("sv") - shared + 1)
    return side("u").join(side("v"), ["family", "feature"]).where(fits).select("u", "v").distinct()


def _only(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The documents whose ids are asked for. A bounded Bloom filter of the ids, looked up before the shuffle, lets few other
    texts into it; of more ids than ``MOST_ASKED`` there is no filter, and all texts are shuffled."""
    asked = saved(asked, "asked")
    n = asked.count()
    if MOST_ASKED // 1000 < n <= MOST_ASKED:  # fewer are broadcast anyway
        docs = docs.where(build_level(asked.select(F.col("doc_id").alias("key")), n, 0, 7).passes(F.col("doc_id")))
    return docs.join(asked, "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (``u``, ``v``) whose sets are similar enough, by exact intersection."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = saved(_only(docs, asked).mapInArrow(lean(_sets(n)), "doc_id long, features array<long>"), "sets")
    release(docs.sparkSession)
    one = pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("features").alias("fv")), "v")
    both = one.join(sets.select(F.col("doc_id").alias("u"), F.col("features").alias("fu")), "u")
    shared = F.size(F.array_intersect("fu", "fv")).cast("long")
    return both.where(100 * shared >= percent * (F.size("fu") + F.size("fv") - shared)).select("u", "v").distinct()


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that links reach."""
    spark = docs.sparkSession
    own = chosen(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    named = own.where("doc_id is not null")
    for seed in range(64):
        first = saved(own.mapInArrow(lean(_first_pass(n, percent, seed)), "kind string, doc_id long, size long, a long, b long, thin boolean, bits array<long>"), "sizes")
        if not first.where("kind = 'doc' and thin").head(1):
            break
    else:
        raise ValueError("no seed deals every set to enough partitions")
    sizes = first.where("kind = 'doc'").select("doc_id", "size", "a", "b")
    sketches = first.where("kind = 'doc' and doc_id is not null").select("doc_id", "size", "bits")
    listed = _most_frequent(first.where("kind = 'feature'").groupBy("doc_id").agg(F.sum("size").alias("n")).where("n >= 16"))
    listed = sorted((r.doc_id % (1 << 64), r.n) for r in listed)
    frequent = spark.sparkContext.broadcast((np.array([x for x, _ in listed], np.uint64), np.array([x for _, x in listed], np.int64)))

    alike = sizes.where("doc_id is not null and size > 0")
    least = saved(alike.groupBy("size", "a", "b").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("hi")).where("v < hi").drop("hi"), "least")
    copies = saved(alike.join(least, ["size", "a", "b"]).where("doc_id > v").select(F.col("doc_id").alias("u"), "v"), "copies")

    signed = named.mapInArrow(lean(_second_pass(n, percent, seed, frequent)), SIGNED)
    group, hot = Window.partitionBy("signature"), F.col("base").isNotNull()
    shared = lambda df: df.withColumn("v", F.min("doc_id").over(group)).withColumn("hi", F.max("doc_id").over(group))
    met = shared(signed).withColumn("n", F.count(F.lit(1)).over(group)).where(hot | F.expr("v < hi")).select("signature", "doc_id", "base", "n")
    # similar sets share more signatures than one, so each does without those of its largest groups: hot ones first, in an
    # order that is one for all that share a signature, salted or not
    own = sketches.groupBy("doc_id").agg(F.min("size").alias("size"))
    band = F.pmod("signature", F.lit(2))
    spare = F.when((F.col("size") <= BANDS[0][0]) & (band == 0), 0).otherwise(F.floor(F.ceil(F.col("size") * percent / 100) / SPARE))
    by_size = Window.partitionBy("doc_id", "band").orderBy(F.desc(hot), F.desc(F.when(~hot, F.col("n"))), F.coalesce("base", "signature"))
    met = met.join(own, "doc_id").withColumn("band", band).withColumn("spare", spare).withColumn("rank", F.row_number().over(by_size)).where("rank > spare").select("signature", "doc_id", "base")
    # signatures of the very same documents are one group; salted groups of one signature meet by their least documents
    met = shared(met).withColumn("members", F.bit_xor(F.xxhash64("doc_id")).over(group)).where(hot | F.expr("v < hi"))
    met = saved(met.groupBy("members", "doc_id", "v", "base").agg(F.lit(1).alias("one")).drop("one"), "met")
    release(spark)
    salted = met.where(hot).select("base", F.col("v").alias("u")).distinct()
    heads = salted.join(salted.groupBy("base").agg(F.min("u").alias("v")), "base").select("u", "v")
    tried = saved(met.select(F.col("doc_id").alias("u"), "v").unionByName(heads).where("u != v").distinct(), "tried")
    likely = saved(may_link(saved(tried.join(copies, ["u", "v"], "left_anti"), "untried"), sketches, percent), "likely")
    links = saved(copies.unionByName(verified(likely, named, n, percent)), "links")
    release(spark)
    reached = components(links)

    # families, documents that groups connect, that still span several components
    family = components(tried).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "family")
    placed = tried.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct().join(family, "doc_id", "left").join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = saved(placed.select("doc_id", F.coalesce("family", "doc_id").alias("family"), F.coalesce("component", "doc_id").alias("component")), "placed")
    spanning = saved(placed.groupBy("family").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b and n > 2").select("family", "n"), "spanning")
    open_ = placed.join(spanning, "family")
    small = open_.where(F.col("n") <= BLOCK)
    small = small.join(_only(sketches, small.select("doc_id").distinct()), "doc_id").select("family", "doc_id", "component", "size", "bits")
    near = small.groupBy("family").applyInArrow(_near_in_family(percent), "u long, v long").distinct()
    if spanning.where(F.col("n") > BLOCK).head(1):
        large = open_.where(F.col("n") > BLOCK).select("family", "doc_id", "component")
        near = near.unionByName(may_link(saved(_near_in_large(large, named, n, percent), "near-in-large"), sketches, percent))
    rest = saved(near.join(tried, ["u", "v"], "left_anti"), "rest")
    release(spark)
    if rest.head(1):
        links = links.unionByName(verified(rest, named, n, percent))
        reached = components(links)
    found = sizes.select("doc_id", F.col("size").alias("n_shingles")).join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those that have a similar document with a smaller id in their component; columns as they are."""
    found = similar_components(docs, id_col=id_col, text_col=text_col, n=n, percent=percent)
    gone = saved(found.where("component_id < doc_id").select("doc_id").distinct(), "others")  # of known size: a few are broadcast
    return flat(docs).join(gone, F.col(place(docs, id_col)).cast("long") == F.col("doc_id"), "left_anti").toDF(*docs.columns)
