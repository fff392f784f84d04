"""Queries on tables that grow by repetition: the work must not grow with the pairs of records."""

import random
from collections import Counter

import numpy as np
import pytest

from splitlens.config import AuditConfig
from splitlens.operators import blocks, cliffs, conflicts
from splitlens.plans import queries
from splitlens.sources.records import canonical


def test_cliffs_of_hot_names_are_counted_without_pairs(spark, tmp_path):
    """Two similar names of 150,000 rows each: 22 billion pairs of records."""
    n = 300_000
    part = spark.range(n).selectExpr("id AS p_partkey", "if(id % 2 = 0, 'hot bolts', 'hot bolt') AS p_name", "concat('Brand#', id % 7) AS p_brand")
    part.write.parquet(f"{tmp_path}/part.parquet")
    side = lambda k: "test" if k % 10 == 9 else "tv"
    own = Counter((k % 2, side(k), k % 7) for k in range(n))
    want = Counter()
    for (a, s, x), p in own.items():
        for (b, t, y), q in own.items():
            if x != y:
                if (s, t) == ("tv", "test"):
                    want["cross_tv_test"] += p * q
                elif s == t and a < b:
                    want[f"intra_{s}"] += p * q
    assert {r.kind: r.n for r in queries.q_consensus_cliffs(spark, str(tmp_path)).collect()} == dict(want)


@pytest.mark.parametrize("seed", range(2))
def test_cliff_counts_are_those_of_the_rows(spark, seed):
    r = random.Random(seed)
    names = {f"{'ab' * 4}{i}": r.choice([None, [], [1, 2, 3], [1, 2, 3, 4], [7, 8]]) for i in range(8)}
    rows = [(i, e := r.choice([*names, None]), e and names[e], r.choice([None, 0.0, 1.0, 2.5]), r.choice(["train", "valid", "test"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, entity string, fp array<int>, label double, split string")
    for task, sigma3 in (("classification", None), ("regression", [1.5])):
        records = canonical(df, AuditConfig(task, columns={"entity": "entity", "label": "label", "id": "id"}), df.id)
        for measures in (("fp",), ("fp", "frame", "text")):
            want = Counter(x.kind for x in cliffs.cliff_rows(records, 0.7, task, sigma3, measures).collect())
            assert {x.kind: x.n for x in cliffs.cliff_counts(records, 0.7, task, sigma3, measures).collect()} == dict(want)


@pytest.mark.parametrize("seed", range(2))
def test_cliffs_of_dense_bits_leave_the_scan_finished(spark, seed, monkeypatch, capsys):
    """Several blocks, entities with several records and two labels, empty sets, missing labels, endless numbers: the rows of the
    joins, without a join of pairs."""
    r = random.Random(seed)
    monkeypatch.setattr(blocks, "BLOCK_SETS", 40)
    monkeypatch.setattr(cliffs, "ROWS", 50)
    monkeypatch.setattr(cliffs, "PART", 2000)
    own = [(f"e{i}", r.choice([None, [], *[sorted(r.sample(range(12), r.choice([4, 6, 8]))) for _ in range(9)]])) for i in range(130)]
    label = lambda: r.choice([None, 0.0, 1.0, 2.5, float("inf")])
    rows = [(i % 90, *(own[i] if i < len(own) else r.choice(own)), label(), label(), r.choice(["train", "valid", "test", "test"])) for i in range(180)]
    df = spark.createDataFrame([*rows, (5, None, [1], 1.0, 1.0, "train")], "id int, entity string, fp array<int>, x double, y double, split string")
    scan = cliffs._scan
    for task, sigma3 in (("classification", None), ("regression", [1.5, 0.0]), ("regression", [2.0, 1.0])):
        records = canonical(df, AuditConfig(task, columns={"entity": "entity", "id": "id"}, label_cols=["x", "y"]), df.id)
        found = cliffs.cliff_rows(records, 0.5, task, sigma3, ("fp", "frame"))
        found.explain()
        assert "Join" not in capsys.readouterr().out.replace("Joined", "").split("FlatMapGroups")[0]
        monkeypatch.setattr(cliffs, "_scan", lambda *_: None)
        want = cliffs.cliff_rows(records, 0.5, task, sigma3, ("fp", "frame"))
        assert found.columns == want.columns
        both = [Counter(map(str, x.collect())) for x in (found, want)]
        assert both[0] == both[1] and len(both[0]) > 100
        monkeypatch.setattr(cliffs, "_scan", scan)
        assert cliffs.cliff_rows(records, 0.5, task, sigma3, ("fp",), ("row_id",)).count() == both[0].total()


def test_products_of_whole_blocks_stay_small():
    sets = blocks.Rows(None, np.zeros(blocks.BLOCK_SETS, np.int32), np.zeros((blocks.BLOCK_SETS, 8), np.uint8))
    sets.ids = range(blocks.BLOCK_SETS)
    parts = list(blocks.products(sets, sets, 64))
    assert max(p.size for _, p in parts) <= 1 << 20 and sum(p.shape[1] for _, p in parts) == blocks.BLOCK_SETS


def test_conflicts_are_found_in_parts_that_follow_the_rows(spark, monkeypatch, capsys):
    monkeypatch.setattr(conflicts, "PART_ROWS", 100)
    df = spark.range(3000).selectExpr("cast(if(id < 1500, 0, id div 2) AS string) AS entity", "if(id % 3 = 0, 'train', 'test') AS split", "array(cast(id % 2 AS string)) AS label_key")
    found = conflicts.classification_conflicts(df)
    found.explain()
    plan = capsys.readouterr().out
    assert "30)" in plan and plan.count("Exchange") == 1
    kinds = {}
    for i in range(3000):
        kinds.setdefault(0 if i < 1500 else i // 2, []).append(("train" if i % 3 == 0 else "test", i % 2))
    n = sum(1 for own in kinds.values() if len({x for _, x in own}) > 1 and {"train", "test"} <= {s for s, _ in own})
    assert conflicts.conflict_counts(found).first().cross_train_test == n > 100
