import json

import pytest
from pyspark.sql import functions as F

from splitlens import cli, sinks
from splitlens.config import AuditConfig, audit_config, check_fractions, discover, output_dir, validated
from splitlens.operators import cliffs, conflicts, hygiene, splitters, structures, targets
from splitlens.operators.baselines import run_baselines
from splitlens.operators.standardize import cleaner, flag_duplicates
from splitlens.plans.audit import audit, audit_targets
from splitlens.sources import records as rec

CLS = AuditConfig("classification")


def table(spark, rows, label="string"):
    """(split, entity, label) to records."""
    df = spark.createDataFrame([(s, e, lab) for s, e, lab in rows], f"split string, smiles string, label {label}")
    return rec.canonical(df, CLS)


def kinds(df):
    return {r.entity: sorted(r.kinds) for r in df.collect()}


def test_duplicates_and_contamination(spark):
    t = table(spark, [("train", e, "0") for e in "aab"] + [("test", e, "0") for e in "bc"])
    r = hygiene.overlap(t, "entity").first()
    assert (r.n_rows, r.n_unique, r.n_duplicates, r.shared_tv_test) == (5, 3, 2, 1)
    assert hygiene.split_counts(t).first().valid is None


def test_classification_conflicts(spark):
    t = table(spark, [("train", "a", "0"), ("train", "a", "1"), ("train", "b", "0"), ("train", "b", "0"), ("test", "b", "1"), ("valid", "c", "1"), ("test", "c", "1.0")])
    found = conflicts.classification_conflicts(t)
    assert kinds(found) == {"a": ["intra_train"], "b": ["cross_train_test", "severe_trainvalid_test"]}
    assert conflicts.conflict_counts(found).first().severe_trainvalid_test == 1
    rows = conflicts.conflict_rows(t, found).collect()
    assert sorted((r.kind, r.split, r.entity) for r in rows if r.entity == "a") == [("intra_train", "train", "a")] * 2
    assert len(rows) == 2 + 3 + 3


def test_null_labels_and_null_entities(spark):
    t = table(spark, [("train", "a", None), ("train", "a", "1"), ("train", "b", None), ("train", "b", "NA"), ("train", None, "0"), ("train", None, "1"), ("test", None, "0")])
    assert kinds(conflicts.classification_conflicts(t)) == {"a": ["intra_train"], None: ["cross_train_test", "severe_trainvalid_test"]}


def test_regression_conflicts_at_above_and_below(spark):
    t = table(spark, [("train", "at", 0.0), ("train", "at", 3.0), ("train", "below", 0.0), ("train", "below", 2.9), ("train", "x", 0.0), ("test", "x", -9.0), ("train", "n", None), ("train", "n", 5.0)], "double")
    assert kinds(conflicts.regression_conflicts(t, [3.0])) == {"at": ["intra_train"], "x": ["cross_train_test", "severe_trainvalid_test"]}
    assert kinds(conflicts.regression_conflicts(t, [0.0])) == {}


def test_multitask_conflict_and_positions(spark):
    df = spark.createDataFrame([("train", "a", 1, 0), ("train", "a", 1, None)], "split string, smiles string, t1 int, t2 int")
    t = rec.canonical(df, AuditConfig("classification", label_cols=["t1", "t2"]))
    assert kinds(conflicts.classification_conflicts(t)) == {"a": ["intra_train"]}
    v = t.withColumn("label_num", F.when(F.col("row_id") == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(7.0))))
    assert kinds(conflicts.regression_conflicts(v, [1.0])) == {"a": ["intra_train"]}


def test_conflicts_equal_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(r.choice(["train", "valid", "test"]), r.choice("abcdefgh"), r.choice(["0", "1", None, "2.0", "2"])) for _ in range(60)]
    key = lambda v: None if v is None else float(v)
    want = {}
    for kind, (a, b) in conflicts.KINDS.items():
        bits = {"train": 1, "valid": 2, "test": 4}
        want[kind] = len({e for s, e, x in rows for s2, e2, y in rows if e == e2 and bits[s] & a and bits[s2] & b and key(x) != key(y)})
    assert conflicts.conflict_counts(conflicts.classification_conflicts(table(spark, rows))).first().asDict() == want


def test_identical_entities_are_cliffs_across_only(spark):
    t = table(spark, [("train", "a", "0"), ("train", "a", "1"), ("test", "a", "1"), ("test", "zz", "0")]).withColumn("fp", F.array(F.lit(1), F.lit(2)))
    t = t.withColumn("fp", F.when(F.col("entity") == "a", F.col("fp")).otherwise(F.array(F.lit(9))))
    rows = cliffs.cliff_rows(t, 0.9, "classification").collect()
    assert [(r.kind, r.label_num_A, r.label_num_B, r.delta) for r in rows] == [("cross_tv_test", [0.0], [1.0], [-1.0])]


def test_consensus_equals_brute_force(spark):
    import random

    from splitlens.functions.similarity import indel_ratio_of
    from splitlens.operators.similarity import consensus_pairs, string_ratio_pairs, tanimoto_pairs

    r = random.Random(8)
    names = sorted({"".join(r.choices("CCCON=", k=r.randint(1, 60))) for _ in range(60)} | {"C" * k for k in range(20, 60, 3)})
    rows = [(n, n, sorted(r.sample(range(30), r.randint(0, 12))) if r.random() < 0.9 else None, sorted(r.sample(range(8), r.randint(1, 4))) if r.random() < 0.8 else None) for n in names]
    df = spark.createDataFrame(rows, "id string, text string, fp array<int>, frame array<int>")
    jac = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    for t in (0.7, 0.9):
        assert {(x.a, x.b) for x in string_ratio_pairs(df, t).collect()} == {(a[0], b[0]) for a, b in pairs if indel_ratio_of(a[0], b[0]) >= t}
        assert {(x.a, x.b) for x in tanimoto_pairs(df.withColumnRenamed("fp", "bits"), t).collect()} == {(a[0], b[0]) for a, b in pairs if a[2] is not None and b[2] is not None and jac(a[2], b[2]) >= t}
    both = lambda a, b, i: a[i] is not None and b[i] is not None
    want = {(a[0], b[0]) for a, b in pairs if (both(a, b, 2) and (jac(a[2], b[2]) >= 0.8 or indel_ratio_of(a[0], b[0]) >= 0.8)) or (both(a, b, 3) and jac(a[3], b[3]) >= 0.8)}
    assert {(x.a, x.b) for x in consensus_pairs(df, 0.8).collect()} == want


def test_targets(spark):
    rows = [("train", "CCO", "aa aa", 0), ("train", "CCN", "BBBB", 1), ("valid", "CCO", "AAAA", 0), ("test", "CCBr", "bbbb", 1), ("test", "C", None, 0)]
    df = spark.createDataFrame(rows, "split string, Ligand string, Protein string, y int")
    config = AuditConfig("classification", "dti", modality="dti", columns={"entity": "Ligand", "sequence": "Protein"})
    t = rec.canonical(df, config)
    r = hygiene.overlap(t, "target_seq").first()
    assert (r.unique_train, r.unique_valid, r.unique_test, r.shared_train_valid, r.shared_train_test, r.n_duplicates) == (2, 1, 2, 1, 1, 2)
    assert [(x.entity, x.target_seq) for x in targets.cross_split_pairs(t).collect()] == [("CCO", "AAAA")]
    assert [(x.target_seq, x.n_entities) for x in targets.top_multi_entity_targets(t).collect()] == [("BBBB", 2)]
    result = audit_targets(t, config)
    assert result.summary["targets"]["conflicts"] == {"cross_split_pairs": 1, "multi_entity": 1}
    assert result.conflicts.count() == 2 + 2
    with pytest.raises(KeyError):
        rec.canonical(df.drop("Protein"), config)


def test_structure_hits_prefer_the_first_in_file(spark):
    hits = spark.createDataFrame([("q", "r1", 5.0, 0.9, 0.1, 1), ("q", "r2", 5.0, 0.9, 0.2, 2), ("q", "q", 1.0, 0.5, 0.0, 3)], "query string, target string, score double, probability double, evalue double, line long")
    ids = spark.createDataFrame([("q", "S", ["test"]), ("r1", "T", ["train"]), ("r2", "U", ["valid", "train"])], "sequence_id string, sequence string, splits array<string>")
    best = structures.best_hits(hits, ids).collect()
    assert {(b.no, b.query, b.target) for b in best} == {(1, "q", "r1"), (2, "q", "r1")}


def test_group_split_is_greedy(spark):
    sides = splitters.assign_groups([5, 3, 1, 1])
    assert sides[:2] == ["train", "train"] and sorted(sides[2:]) == ["test", "valid"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate("aaaaabbbcd")] + [(10, None)], "row_id long, g string")
    out = splitters.group_split(df, "g")
    assert out.count() == 11 and out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_random_split_is_seeded_and_exact(spark):
    df = spark.range(101).withColumnRenamed("id", "row_id")
    out = splitters.random_split(df)
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 80, "valid": 10, "test": 11}
    assert out.exceptAll(splitters.random_split(df)).count() == 0
    for bad in ([0.5, 0.5], [0.9, 0.2, -0.1], [0.5, 0.2, 0.2]):
        with pytest.raises(ValueError):
            check_fractions(bad)


def test_duplicate_flags_and_cleaners(spark):
    t = table(spark, [("train", "a", "0"), ("train", "a", "1"), ("test", "a", "1"), ("train", None, "1"), ("train", None, "1")])
    assert [r.valid for r in flag_duplicates(t).orderBy("split", "row_id").collect()] == [True, True, False, True, False]
    assert cleaner(None) is None and cleaner("False") is None
    with pytest.raises(ValueError):
        cleaner("os.system")


def test_sources_and_errors(spark, tmp_path):
    (tmp_path / "one.csv").write_text("compound_id,smiles,label,split\ntr1,CCO,0,train\ntr2,CCN,1,Train\nv1,CCC,0,val\nt1,CCBr,1,test\nt2,CCCl,0,TEST\n")
    config = AuditConfig("classification", path=str(tmp_path / "one.csv"))
    t = rec.load(spark, config)
    assert [r.entity for r in t.where("split = 'train'").orderBy("row_id").collect()] == ["CCO", "CCN"]
    assert [r.label_num for r in t.where("split = 'test'").orderBy("row_id").collect()] == [[1.0], [0.0]]
    with pytest.raises(ValueError, match="unsupported"):
        rec.read_table(spark, "x.tab")
    bad = spark.createDataFrame([("a", 1, "dev")], "smiles string, label int, split string")
    with pytest.raises(ValueError, match="dev"):
        rec.from_one_table(bad, config)
    with pytest.raises(ValueError, match="empty"):
        rec.from_one_table(bad.withColumn("split", F.lit("test")), config)
    with pytest.raises(KeyError):
        rec.canonical(bad.drop("smiles"), CLS)
    with pytest.raises(KeyError):
        rec.canonical(bad.drop("label"), CLS)


def test_row_numbers_count_from_zero_in_each_split(spark):
    df = spark.range(1000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), F.col("id"))
    rows = rec.numbered(df).collect()
    for split in ("train", "test"):
        own = sorted((r.row_id, r.id) for r in rows if r.split == split)
        assert [i for i, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)


def test_config_rules(tmp_path):
    for bad in ([], {"type": "tabular"}, {"path": "a", "paths": {}}, {"paths": {"train": "a"}}):
        with pytest.raises(ValueError):
            validated(bad)
    c = audit_config({"type": "tabular", "path": "a.csv", "task": "classification", "info": {"sim_threshold": 0, "smiles_col": "S"}})
    assert c.threshold == 0.9 and c.columns == {"entity": "S"} and c.seed == 0
    with pytest.raises(ValueError):
        AuditConfig("classification", threshold=1.5)
    (tmp_path / "b").mkdir()
    for name in ("z.yml", "b/a.yaml", "b/c.txt"):
        (tmp_path / name).write_text("type: tabular\npath: x.csv\n")
    assert [p.name for p in discover(tmp_path, tmp_path / "z.yml")] == ["z.yml", "a.yaml"]
    assert output_dir({"name": "A b", "out": "runs/x"}, "runs", tmp_path / "b/a.yaml", tmp_path).parts[-3:] == ("runs", "b", "A-b")
    assert output_dir({"name": "n", "info": {"split": "scaffold"}, "type": "tdc"}, tmp_path).name == "n-scaffold"


def test_cli_writes_and_skips(spark, tmp_path):
    rows = ["compound_id,smiles,label,split"] + [f"{s}{i},{e},{i % 2},{s}" for s in ("train", "valid", "test") for i, e in enumerate(["CCO", "CCN", "CCC"])]
    (tmp_path / "d.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "c.yaml").write_text(f"type: tabular\nname: demo\ntask: classification\npath: {tmp_path}/d.csv\nout: {tmp_path}/out\n")
    folder = cli.run_one(spark, tmp_path / "c.yaml", tmp_path)
    summary = json.loads((folder / "summary.json").read_text())
    assert summary["counts"] == {"train": 3, "valid": 3, "test": 3} and summary["config"]["name"] == "demo"
    assert len((folder / "records.csv").read_text().splitlines()) == 10 and not (folder / "conflicts.jsonl").exists()
    (folder / "summary.json").write_text("{}")
    assert cli.run_one(spark, tmp_path / "c.yaml", tmp_path) == folder and (folder / "summary.json").read_text() == "{}"
    assert sinks.plain({"a": float("nan"), "b": (1, None), "c": object}) == {"a": None, "b": [1, None], "c": str(object)}


def test_baselines_and_their_guards(spark):
    rows = [("train", "a", 0), ("train", "b", 0), ("train", "c", 1), ("train", "d", 1), ("test", "e", 0), ("test", "f", 1)]
    t = table(spark, rows, "int").withColumn("x", F.col("label_num")[0] * 2 + 1)
    done = run_baselines(t, trees=5, columns=["x"])
    assert done["task"] == "classification" and done["models"]["random_forest"]["metrics"]["roc_auc"] == 1.0
    with pytest.raises(ValueError):
        run_baselines(t.where("split = 'train'"))
    with pytest.raises(NotImplementedError):
        run_baselines(t.withColumn("label_num", F.array(F.lit(1.0), F.lit(2.0))))


def test_audit_summary(spark):
    t = table(spark, [("train", "a", "0"), ("train", "b", "1"), ("test", "a", "1")]).withColumn("fp", F.array(F.ascii("entity") % 8))
    s = audit(t, AuditConfig("classification", fp_bits=64)).summary
    assert s["conflicts"]["severe_trainvalid_test"] == 1 and s["cliffs"]["cross_tv_test"] == 1 and s["similarity"]["test_to_train"] == {"mean": 1.0, "std": 0.0, "n": 1}
    assert s["counts"]["valid"] is None and s["task"]["label_tv_mean"] == 0.5
