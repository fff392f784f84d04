"""Prefix trie of conversations: which beginnings they share, and how many words a cache of prefixes saves.

A conversation is a sequence of turns (role and text), kept as one 16-byte digest and one word count a turn; texts are
read once and never shuffled. Conversations with the same sequence become one row first, so copies cost nothing later.
Rows are hash-partitioned by the digest of their first turn. In ``applyInPandas`` each bucket grows a trie of
dictionaries and numbers its nodes in the order they appear, parents first; going back through that order is a
postorder without recursion, in which every node hands its totals to its parent.

A first turn whose rows hold more than ``bound`` turns is oversized. Its rows leave the bucket and are partitioned anew by
the turn behind their longest common beginning (a ``stem``), and again as long as a subtrie is oversized and has two
different rows. Stems are one chain of nodes each and at most turns / ``bound`` a round; the driver holds their
digests and totals, nothing else, and puts them on top of the subtries at the end. A round costs two small jobs; there
are as many as an oversized path has branchings.

The conversations that end at a node are digested in ascending order: ids are joined within runs of 4096 consecutive numbers,
and the runs of one sequence stream through one hash, so a third of all conversations may end at a node.

Defined results: null role or text is empty; turns go by number, null first, then by digest; rows without conversation id
take no part; repeated rows are turns of their own; without any conversation there is no node, not even a root.
The digests of one conversation have to fit in one row (a million turns take 20 MB). Columns of the input, whatever their
names, never clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import chosen, column, lean, saved

WORD = r"[^\x20\x09-\x0D]+"
STEP = 16  # bytes of a turn's digest
LEAST_BOUND, MOST_BOUND, STEMS = 2_000, 200_000, 10_000
MOST_STEM = 4096  # turns of a stem; a longer common beginning is several
RUN = 12  # bits: ids of a run, joined at once
NONE = hashlib.sha256(b"").hexdigest()

ROW = "path binary, words array<int>, n long, first long, ends string"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``keys`` (a digest of role and text for each turn, as hex) and ``words``, in order of turns."""
    own = chosen(conversations, conv=conv_id, turn=turn, role=role, text=text).where("conv is not null")
    said, by = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    one = F.struct("turn", F.md5(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said)).alias("key"), F.regexp_count(said, F.lit(WORD)).alias("words"))
    in_order = own.select(F.col("conv").cast("long").alias("conv"), one.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return in_order.select("conv", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))


def forked(conversations: DataFrame, every: int, most: int) -> DataFrame:
    """``sequences`` in which each conversation begins like the leader of its ``every`` ids: the leader's first h turns, then
    its own after its first h; h is the CRC32 of its decimal id modulo ``most``."""
    lead = F.col("conv") - F.col("conv") % every
    heads = conversations.where(F.col("conv") % every == 0).select(F.col("conv").alias("lead"), *[F.slice(c, 1, max(1, most - 1)).alias(f"head_{c}") for c in ("keys", "words")])
    both = conversations.withColumn("lead", lead).join(heads, "lead", "left").withColumn("h", (F.crc32(F.col("conv").cast("string")) % most).cast("int"))
    part = lambda c, kind: F.concat(F.slice(F.coalesce(f"head_{c}", F.array().cast(kind)), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c)
    return both.select("conv", part("keys", "array<string>"), part("words", "array<int>"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids in order of sequence and number to one row a sequence: how many ids, the first, and their digest."""
    own, digest, n, first = None, None, 0, None

    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": pa.array([d[0] for d in done], pa.int64()), "first": pa.array([d[1] for d in done], pa.int64()), "ends": pa.array([d[2] for d in done], pa.string())})

    for batch in batches:
        done = []
        for key, ids, count, least in zip(*(column(batch, c).to_pylist() for c in ("sequence", "ids", "n", "first")), strict=True):
            if key == own:
                digest.update(b"," + ids.encode())
                n += count
                continue
            if own is not None:
                done.append((n, first, digest.hexdigest()))
            own, digest, n, first = key, hashlib.sha256(ids.encode()), count, least
        yield rows(done)
    if own is not None:
        yield rows([(n, first, digest.hexdigest())])


def _distinct(seqs: DataFrame) -> DataFrame:
    """``ROW``: a row for each different sequence, with the conversations that are it."""
    named = saved(seqs.select("conv", F.unhex(F.array_join("keys", "")).alias("path"), "words"), "trie-sequences")
    runs = named.groupBy(F.md5("path").alias("sequence"), F.shiftright("conv", RUN).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("first")
    )
    ends = runs.repartition("sequence").sortWithinPartitions("sequence", "run").mapInArrow(lean(_digests), "n long, first long, ends string")
    return saved(ends.join(named, F.col("first") == F.col("conv")).select("path", "words", "n", "first", "ends"), "trie-rows")


@dataclass
class Stem:
    """A chain of nodes below the last node of ``parent``: what all rows of an oversized subtrie begin with."""

    no: int
    parent: int | None
    depth: int  # of its last node
    words: list[int] = field(default_factory=list)
    n: int = 0
    first: int | None = None
    leaves: int = 0
    saved: int = 0
    children: int = 0
    ends: str = NONE

    def take(self, n: int, first: int, leaves: int = 0, saved: int = 0, children: int = 0) -> None:
        self.n, self.leaves, self.saved, self.children = self.n + n, self.leaves + leaves, self.saved + saved, self.children + children
        self.first = first if self.first is None else min(self.first, first)


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start; of a sorted set, its first and last have what all have."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * STEP] == b[: mid * STEP] else (low, mid - 1)
    return low


def _stemmed(rows: DataFrame, bound: int) -> tuple[DataFrame, list[Stem]]:
    """``rows`` with ``stem`` and ``skip``, the stem's depth; no subtrie below a stem is oversized unless it is one row."""
    spark, stems, fresh = rows.sparkSession, [Stem(0, None, 0)], 0
    turns = (F.length("path") / STEP).cast("int")
    top = F.substring("path", STEP * F.col("skip") + 1, F.lit(STEP))
    rows = rows.withColumn("stem", F.lit(0)).withColumn("skip", F.lit(0))
    while True:
        new = rows.where((F.col("stem") >= fresh) & (turns > F.col("skip"))).withColumn("top", top)
        sizes = new.groupBy("stem", "top").agg(F.sum(turns - F.col("skip")).alias("size"), F.count(F.lit(1)).alias("n"))
        big = sizes.where((F.col("size") > bound) & (F.col("n") > 1)).select("stem", "top").orderBy("stem", "top").collect()  # at most turns / bound
        if not big:
            return rows, stems
        named = F.broadcast(spark.createDataFrame(big, "stem int, top binary"))
        begin = lambda c: F.substring(c, F.lit(1), STEP * (F.col("skip") + MOST_STEM))
        ends = new.join(named, ["stem", "top"]).groupBy("stem", "skip", "top").agg(F.min(F.struct(begin("path").alias("path"), F.slice("words", 1, F.col("skip") + MOST_STEM).alias("words"))).alias("low"), F.max(begin("path")).alias("high"))
        fresh, dealt = len(stems), []
        for r in ends.orderBy("stem", "top").collect():
            low, high = bytes(r.low.path), bytes(r.high)
            depth = common_turns(low, high)
            dealt.append((r.stem, bytes(r.top), len(stems), depth))
            stems.append(Stem(len(stems), r.stem, depth, r.low.words[r.skip : depth]))
        table = F.broadcast(spark.createDataFrame(dealt, "stem int, top binary, new_stem int, new_skip int"))
        moved = rows.withColumn("top", top).join(table, ["stem", "top"], "left")
        rows = saved(moved.select("path", "words", "n", "first", "ends", F.coalesce("new_stem", "stem").alias("stem"), F.coalesce("new_skip", "skip").alias("skip")), "trie-stemmed")


def grow(rows: pd.DataFrame) -> pd.DataFrame:
    """The tries of one bucket: ``NODE`` and ``stem``, of nodes right below a stem its number, else null."""
    tops: dict = {}
    kids: list[dict] = []
    parent, depth, words, n, first, ends, stem = [], [], [], [], [], [], []

    def node(at: int, deep: int, own: int, no: int | None) -> int:
        for column_, value in zip((kids, parent, depth, words, n, first, ends, stem), ({}, at, deep, own, 0, None, NONE, no), strict=True):
            column_.append(value)
        return len(kids) - 1

    for path, own, count, conv, digest, no, skip in zip(*(rows[c] for c in ("path", "words", "n", "first", "ends", "stem", "skip")), strict=True):
        at, table = -1, tops
        for d in range(skip, len(path) // STEP):
            key = path[d * STEP : (d + 1) * STEP]
            key = (no, key) if at < 0 else key
            found = table.get(key)
            if found is None:
                found = table[key] = node(at, d + 1, int(own[d]), no if at < 0 else None)
            at, table = found, kids[found]
        n[at], first[at], ends[at] = n[at] + count, conv if first[at] is None else min(first[at], conv), digest
    leaves, spared = [0] * len(kids), [0] * len(kids)
    for i in range(len(kids) - 1, -1, -1):  # every node comes behind its parent: backwards, all children are done
        leaves[i] += not kids[i]
        spared[i] += (n[i] - 1) * words[i]
        if (up := parent[i]) >= 0:
            n[up] += n[i]
            leaves[up] += leaves[i]
            spared[up] += spared[i]
            first[up] = first[i] if first[up] is None else min(first[up], first[i])
    return pd.DataFrame({
        "conv_id": pd.array(first, "Int64"), "depth": pd.array(depth, "Int64"), "parent_conv_id": pd.array([None if p < 0 else first[p] for p in parent], "Int64"), "n_convs": pd.array(n, "Int64"),
        "n_children": pd.array([len(k) for k in kids], "Int64"), "n_leaves": pd.array(leaves, "Int64"), "saved_tokens": pd.array(spared, "Int64"), "ends_sha256": pd.array(ends, "string"), "stem": pd.array(stem, "Int32"),
    })


def _chains(stems: list[Stem]) -> list[tuple]:
    """The nodes of all stems, deepest stems first, once their subtries' totals are in."""
    out = []
    for s in reversed(stems):
        s.leaves = s.leaves or 1
        if s.parent is None:
            out.append((s, s.first, 0, None, s.n, s.children, s.leaves, s.saved, s.ends))
            continue
        for k, words in reversed(list(enumerate(s.words))):
            depth, last, top = s.depth - len(s.words) + 1 + k, k == len(s.words) - 1, k == 0
            s.saved += (s.n - 1) * words
            out.append((stems[s.parent] if top else s, s.first, depth, 1, s.n, s.children if last else 1, s.leaves, s.saved, s.ends if last else NONE))
        stems[s.parent].take(s.n, s.first, s.leaves, s.saved, 1)
    return [(first, depth, None if up is None else above.first, *rest) for above, first, depth, up, *rest in out]


def trie(seqs: DataFrame, bound: int | None = None) -> DataFrame:
    """A row for each node (``NODE``): the smallest conversation that goes through it and its depth, which name it, its
    parent's, the conversations through it, its children, the leaves of its subtree, the words of its subtree that are said
    again, and the digest of the conversations that end there. ``bound`` is by default the turns over ``STEMS``, within
    ``LEAST_BOUND`` and ``MOST_BOUND``; any bound gives the same nodes."""
    spark, rows = seqs.sparkSession, _distinct(seqs)
    turns = rows.agg(F.sum(F.length("path") / STEP)).first()[0]
    if turns is None:
        return spark.createDataFrame([], NODE)
    bound = bound or min(MOST_BOUND, max(LEAST_BOUND, int(turns) // STEMS))
    rows, stems = _stemmed(rows, bound)
    below = F.length("path") > STEP * F.col("skip")
    next_turn = F.substring("path", STEP * F.col("skip") + 1, F.lit(STEP))
    bucket = F.pmod(F.xxhash64("stem", next_turn), F.lit(max(1, math.ceil(turns / bound))))
    grown = saved(rows.where(below).withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda own: grow(own), f"{NODE}, stem int"), "trie-nodes")
    tops = grown.where("stem is not null").groupBy("stem").agg(F.sum("n_convs").alias("n"), F.min("conv_id").alias("first"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("children"))
    for r in tops.collect():  # a row a stem
        stems[r.stem].take(r.n, r["first"], r.leaves, r.saved, r.children)
    for r in rows.where(~below).select("stem", "n", "first", "ends").collect():  # the one sequence that is its stem, if any
        stems[r.stem].take(r.n, r["first"])
        stems[r.stem].ends = r.ends
    chains = spark.createDataFrame(_chains(stems), NODE)
    above = F.broadcast(spark.createDataFrame([(s.no, s.first) for s in stems], "stem int, above long"))
    own = grown.join(above, "stem", "left").select(*[F.coalesce(c, "above").alias(c) if c == "parent_conv_id" else c for c in grown.columns if c != "stem"])
    return own.unionByName(chains)
