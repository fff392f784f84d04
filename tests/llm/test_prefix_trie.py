"""The trie against brute force, whatever is oversized, and on awkward conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from splitlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def nodes_by_hand(rows, fork=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t for _, _, t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if fork else 0
        built[c] = tuple(own.get(c - int(abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + turns[h:])
    through, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            through[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(through, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(through[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    digest = lambda ids: hashlib.sha256(",".join(str(c) for c in sorted(ids)).encode()).hexdigest()
    return sorted((min(cs), len(p), min(through[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], digest(ends[p])) for p, cs in through.items())


def found(spark, rows, fork=True, **options):
    seqs = prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in prefix_trie.trie(prefix_trie.forked(seqs, 20, 4) if fork else seqs, **options).collect())


def conversations(seed, n=70, words=4):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "bot", None]), r.choice([None, "", *[" ".join(["w"] * k) for k in range(1, words)]])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_nodes_equal_brute_force_at_any_bound(spark, seed):
    rows = conversations(seed)
    expected = nodes_by_hand(rows)
    assert len(expected) > 100
    assert found(spark, rows) == expected
    assert found(spark, rows, bound=3) == expected


def test_oversized_subtries_are_partitioned_anew_behind_what_they_share(spark):
    """A third begins alike for 30 turns, among them copies, one that ends there, and one that ends within a branch."""
    shared = [(t, "user", f"turn {t}") for t in range(30)]
    rows = []
    for c in range(60):
        own = shared + ([] if c == 7 else [(30 + k, "bot", f"{c % 5} {k}") for k in range(1 + c % 7)])
        rows += [(c, *t) for t in (own if c % 3 == 0 or c == 7 else [(0, "user", f"other {c}")])]
    expected = nodes_by_hand(rows, fork=False)
    assert found(spark, rows, fork=False, bound=20) == expected
    saved = prefix_trie._distinct(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA)))
    stemmed, stems = prefix_trie._stemmed(saved, 6)
    assert len(stems) > 3 and stems[1].depth == 30 and max(s.depth for s in stems) > 30
    turns, skip = (F.length("path") / 16).cast("int"), F.col("skip")
    sizes = stemmed.where(turns > skip).groupBy("stem", F.substring("path", 16 * skip + 1, F.lit(16))).agg(F.sum(turns - skip).alias("size"), F.count("*").alias("n"))
    assert sizes.where("size > 6 and n > 1").count() == 0


def test_long_stems_are_cut_and_go_on(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MOST_STEM", 4)
    rows = [(c, t, "user", f"turn {t}" if t < 11 else f"{c} {t}") for c in range(6) for t in range(13)]
    assert found(spark, rows, fork=False, bound=10) == nodes_by_hand(rows, fork=False)


def test_many_conversations_end_at_one_node_over_many_runs_of_ids(spark):
    rows = [(c * 1500, 0, "user", "hello there") for c in range(40)] + [(7, 0, "user", "hello there")]
    assert found(spark, rows, fork=False) == nodes_by_hand(rows, fork=False)


def test_awkward_conversations(spark):
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, None, None, None), (5, 1, "", "a\tb"), (-20, 0, "u", "a"), (-23, 0, "u", "b"), (20, 0, "u", ""), (21, 2, "u", "é中文 x\x00y"), (21, 2, "u", "second of a tie"), (9, 0, "ab", "c"), (10, 0, "a", "bc")]
    assert found(spark, rows) == nodes_by_hand(rows)
    assert found(spark, rows, bound=1) == nodes_by_hand(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []


def test_long_texts_long_conversations_and_clashing_columns(spark):
    rows = [(c, t, "user", "word " * (200_000 if t == 0 else 1) + ("" if c < 2 else str(t))) for c in range(3) for t in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("conv", "words", "keys", "path", "n", "first", "lead", "h", "TEXT_", "stem")})
    nodes = prefix_trie.trie(prefix_trie.sequences(df), bound=100)
    assert nodes.count() == 1 + 2 * 1500
    root = nodes.where("depth = 0").first()
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (3, 2, 2, 200_000 + 1499)
