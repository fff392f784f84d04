"""The jobs on growing copies of small tables: nothing counts twice, and reruns give the same."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import clean_splits, pair_ledger
from jobs.common import load_config

TEXTS = ["alone", "twice in train", "twice in train", "train and test", "train and test", "same label", "same label", "call 123456789 now", None, None, "", "mixed"]


def tables(spark, folder):
    ids = [0, 1, 2, 3, 8, 4, 9, 5, 6, 18, 7, 17]  # 0 to 6 train, 7 valid, 8 and 9 test, modulo 10
    docs = spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "doc_id long, text string").withColumn("verdict_", F.lit("own")).withColumn("n_chars", F.length("text"))
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (8, 1, 1), (4, 1, 0), (4, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    marks.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return f"{folder}/documents.parquet", f"{folder}/labels.parquet", f"{folder}/out"


def test_every_record_gets_a_verdict_and_a_rerun_the_same(spark, tmp_path):
    docs, labels, out = tables(spark, tmp_path)
    runs = []
    for _ in range(2):
        totals = clean_splits.run(spark, docs, labels, out)
        rows = spark.read.parquet(f"{out}/records").collect()
        runs.append({r.row_id: (r.split, r.verdict, tuple(r.reasons)) for r in rows})
        assert len(rows) == len(TEXTS) == totals["records"]
    assert runs[0] == runs[1]
    got = runs[0]
    assert got[0] == ("train", "kept", ())
    assert got[1] == ("train", "conflict", ("conflict",))
    assert got[2] == ("train", "duplicate", ("duplicate", "conflict"))
    assert got[3] == ("train", "contaminated", ("contaminated", "conflict"))
    assert got[8] == ("test", "conflict", ("conflict",))
    assert got[4] == ("train", "contaminated", ("contaminated",))  # its labels are the largest of each column
    assert got[9] == ("test", "kept", ())
    assert got[5] == ("train", "alert", ("alert",))
    assert got[6] == ("train", "kept", ()) and got[18] == ("test", "kept", ())  # null is no text that could leak
    summary = {(r.split, r.verdict): r.n for r in spark.read.json(f"{out}/summary").collect()}
    assert sum(summary.values()) == len(TEXTS) and summary["train", "kept"] == 2


def test_the_job_takes_another_config_and_an_empty_table(spark, tmp_path):
    docs, labels, out = tables(spark, tmp_path)
    config = load_config(None, "clean_splits") | {"rules": [], "split": {"key": "doc_id", "parts": 1, "train": 1, "valid": 0}}
    totals = clean_splits.run(spark, docs, labels, out, config)
    assert totals["contaminated"] == totals["alert"] == 0 and totals["duplicate"] == 4
    spark.read.parquet(docs).limit(0).write.parquet(f"{tmp_path}/none.parquet")
    none = f"{tmp_path}/none.parquet", labels, f"{tmp_path}/out2"
    assert clean_splits.run(spark, *none)["records"] == 0 == clean_splits.cleaned(spark, *none).count()


SCHEMA = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string"
PARTS = [
    [(1, 1, 7, 1, "A"), (2, 1, 7, 1, "A"), (3, 1, 8, 1, "A"), (4, 1, None, 2, "N"), (5, 1, 9, 9, None)],
    [(8, 1, 7, 1, "A"), (13, 1, 8, 1, "R"), (9, 1, None, 2, "N")],
    [(19, 1, 9, 9, "A"), (21, 1, 7, 1, "R"), (3, 2, 10, 1, "A")],
]


def ledger_rows(spark, out):
    rows = pair_ledger.read_ledger(spark, out).collect()
    return sorted((str(r.entity), str(r.target_seq), r.n_rows, r.n_labels, r.mask, r.first_row, r.cross_split, tuple(r.kinds)) for r in rows)


def grown(spark, folder, upto):
    for i in range(upto):
        if not (folder / f"part{i}").exists():
            spark.createDataFrame(PARTS[i], SCHEMA).coalesce(1).write.parquet(str(folder / f"part{i}"))
            file = next((folder / f"part{i}").glob("part-*.parquet"))
            (folder / "in").mkdir(exist_ok=True)
            file.rename(folder / "in" / f"{i}.parquet")
    return str(folder / "in")


def test_the_ledger_takes_only_what_is_new(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    settings = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    (tmp_path / "in").mkdir()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert pair_ledger.run(spark, str(tmp_path / "none"), str(tmp_path / "empty"), str(tmp_path / "check0")) == 0 and ledger_rows(spark, tmp_path / "empty") == []
    assert pair_ledger.run(spark, grown(spark, tmp_path, 1), out, check) == 5
    assert ledger_rows(spark, out) == []
    assert pair_ledger.run(spark, grown(spark, tmp_path, 2), out, check) == 3
    assert pair_ledger.run(spark, grown(spark, tmp_path, 3), out, check) == 3
    stepwise = ledger_rows(spark, out)
    before = sorted(str(p) for p in (tmp_path / "out").rglob("*.parquet"))
    assert pair_ledger.run(spark, str(tmp_path / "in"), out, check) == 0
    assert before == sorted(str(p) for p in (tmp_path / "out").rglob("*.parquet"))
    assert pair_ledger.run(spark, str(tmp_path / "in"), str(tmp_path / "once"), str(tmp_path / "check2")) == 11
    assert stepwise == ledger_rows(spark, tmp_path / "once")
    one_by_one = load_config(None, "pair_ledger") | {"max_files_per_batch": 1, "buckets": 3}
    pair_ledger.run(spark, str(tmp_path / "in"), str(tmp_path / "single"), str(tmp_path / "check3"), one_by_one)
    assert stepwise == ledger_rows(spark, tmp_path / "single")
    assert stepwise == [
        ("7", "1", 4, 2, 3, 11, True, ("cross_train_valid", "intra_train")),
        ("8", "1", 2, 2, 1, 31, False, ("intra_train",)),
        ("9", "9", 2, 2, 5, 51, True, ("cross_train_test", "severe_trainvalid_test")),
        ("None", "2", 2, 1, 5, 41, True, ()),
    ]
    assert settings == {k: spark.conf.get(k) for k in settings}


def test_a_batch_that_failed_half_way_counts_once(spark, tmp_path, monkeypatch):
    records, out, check = grown(spark, tmp_path, 2), str(tmp_path / "out"), str(tmp_path / "check")
    whole = pair_ledger.ledger
    monkeypatch.setattr(pair_ledger, "ledger", lambda found: 1 / 0)
    with pytest.raises(Exception, match="division"):
        pair_ledger.run(spark, records, out, check)  # deltas are written, the ledger isn't
    monkeypatch.setattr(pair_ledger, "ledger", whole)
    assert pair_ledger.run(spark, records, out, check) == 8
    assert pair_ledger.run(spark, records, str(tmp_path / "once"), str(tmp_path / "check2")) == 8
    assert ledger_rows(spark, out) == ledger_rows(spark, tmp_path / "once")


def test_configs_are_json_files(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"buckets": 2}))
    assert load_config(tmp_path / "c.json", "pair_ledger") == {"buckets": 2}
    assert load_config(None, "clean_splits")["entity"] == "text"


def test_command_lines(spark, tmp_path):
    """Each in a process and session of its own."""
    root = str(Path(clean_splits.__file__).resolve().parent.parent)
    docs, labels, out = tables(spark, tmp_path)
    records = grown(spark, tmp_path, 2)
    runs = [["jobs.clean_splits", "--records", docs, "--labels", labels, "--out", out], ["jobs.pair_ledger", "--records", records, "--out", str(tmp_path / "ledger"), "--checkpoint", str(tmp_path / "check")]]
    for job in runs:
        done = subprocess.run([sys.executable, "-m", *job], cwd=root, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "reading" in done.stderr and "wrote" in done.stderr and "read " in done.stderr
    assert spark.read.parquet(f"{out}/records").count() == len(TEXTS)
    assert len(ledger_rows(spark, tmp_path / "ledger")) == 3
