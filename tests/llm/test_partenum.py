import re
from collections import defaultdict

import numpy as np
import pytest

from splitlens.llm import partenum
from splitlens.llm.components import components
from tests.llm.data import awkward, near_copies


def brute(rows, n=5, percent=75):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rows = near_copies(seed, groups=8, copies=9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want
    assert sum(c != i for i, (_, c) in want.items()) > 5


@pytest.mark.parametrize("block", [3, 512])
@pytest.mark.parametrize("seed", [11, 12])
def test_small_blocks_and_hot_signatures_change_nothing(spark, monkeypatch, block, seed):
    monkeypatch.setattr(partenum, "BLOCK", block)
    rows = near_copies(seed, groups=3, copies=25, n=40)
    got = {r.doc_id: r.component_id for r in partenum.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_asked_documents_by_filter_or_without(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id as doc_id", "string(id) as text")
    asked = spark.range(0, 9000, 7).selectExpr("id as doc_id")
    for most in (100, 1 << 20, 100_000):
        monkeypatch.setattr(partenum, "MOST_ASKED", most)
        assert sorted(r.doc_id for r in partenum._only(docs, asked).collect()) == list(range(0, 5000, 7))


def test_listed_features_come_last_with_their_counts():
    r = np.random.default_rng(6)
    features = np.unique(r.integers(0, 1 << 63, 40).astype(np.uint64))
    listed = features[8:]
    signed, n = partenum.counted_signatures(features, listed, np.full(len(listed), 9000), 0, 75)
    assert n.tolist() == [0] * 8 + [9000] * (len(n) - 8) and (partenum.signatures(features, listed, 0, 75) == signed).all()


def test_large_families_of_no_links(spark, monkeypatch):
    """A common part and a part of one's own: many that are no links, a few that are."""
    import random

    monkeypatch.setattr(partenum, "BLOCK", 16)
    monkeypatch.setattr(partenum, "HOT", 20)
    r = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"own{i}x{k}" for k in range(24)])) for i in range(150)]
    for i in range(150, 170):
        text = rows[r.randrange(150)][1].split()
        for _ in range(r.randint(1, 2)):
            text[r.randrange(len(text))] = f"new{r.randint(0, 99)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert 140 < len({c for _, c in want.values()}) < 170
    monkeypatch.setattr(partenum, "_second_pass", _with(partenum._second_pass, "HOT", 20))
    joined, large = [], partenum._near_in_large
    monkeypatch.setattr(partenum, "_near_in_large", lambda members, *rest: joined.append(members.count()) or large(members, *rest))
    assert {x.doc_id: x.component_id for x in partenum.similar_components(docs).collect()} == {i: c for i, (_, c) in want.items()}
    assert joined and joined[0] > 100


def _with(make, name, value):
    """``make``, whose functions set a module's value where they run: workers don't see what a test patches."""

    def made(*args):
        run = make(*args)

        def patched(batches):
            from splitlens.llm import partenum as there

            before = getattr(there, name)
            setattr(there, name, value)
            try:
                yield from run(batches)
            finally:
                setattr(there, name, before)

        return patched

    return made


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(5)
    for _ in range(400):
        size = int(r.integers(3, 500))
        a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
        change = int(r.integers(0, max(1, size // 7) + 1))
        b = np.unique(np.concatenate([a[change:], r.integers(0, 1 << 63, change).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 75 * (len(a) + len(b) - shared) or (len(a) == len(b) == shared):
            continue
        frequent = np.sort(r.choice(a, len(a) // 3, replace=False)) if size % 2 else np.zeros(0, np.uint64)
        for seed in (0, 3):
            x, y = (partenum.signatures(z, frequent, seed, 75) for z in (a, b))
            assert len(np.intersect1d(x, y))
        sa, sb = partenum.sketch(a).view(np.uint64), partenum.sketch(b).view(np.uint64)
        if len(sa) == len(sb):
            assert np.bitwise_count(sa ^ sb).sum() <= len(a) + len(b) - 2 * shared


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = partenum.similar_components(docs).collect()
    assert len(got) == docs.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.n_shingles, r.component_id))
    assert by_id[900] == {(0, 900)} and by_id[901] == {(0, 901)} and by_id[902] == {(0, 902)} and by_id[903] == {(1, 903)}
    assert {c for i in (904, 905, 906) for _, c in by_id[i]} == {904}
    assert {c for _, c in by_id[None]} == {None}
    kept = partenum.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [900, 901, 902, 903, 904, 907, 908]
    assert partenum.similar_components(docs.limit(0)).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}, 201: 200}
