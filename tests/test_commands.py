"""Commands end to end: the registry and its exports, alert rules of a config, results that are made again."""

import json

import pytest

from splitlens import cli, registry

CSV = "Drug,Target,Y,split\nCC,aa c,1,train\nCO,AAC,0,valid\nCN,gg,1,test\nCC call 123456789,GG,0,test\nCO,,1,train\n"


def dti(folder, name="one"):
    (folder / f"{name}.csv").write_text(CSV)
    path = folder / f"{name}.yaml"
    path.write_text(f"type: dti\nname: {name}\ntask: classification\npath: {folder}/{name}.csv\ninfo:\n  sequence_col: Target\n")
    return path


def test_registry_and_exports(spark, tmp_path):
    configs = [dti(tmp_path, "one"), dti(tmp_path, "two")]
    (tmp_path / "three.yaml").write_text(f"type: tabular\nname: t\ntask: classification\npath: {tmp_path}/one.csv\n")
    assert registry.run(spark, [*configs, tmp_path / "three.yaml"], str(tmp_path / "out"), fasta=True, csv=True, fold_jobs=True) == 2
    rows = {r["sequence"]: r for r in map(json.loads, (x for p in (tmp_path / "out" / "registry").glob("part-*") for x in p.read_text().splitlines()))}
    assert rows["AAC"]["sequence_id"].endswith("@one") and len(rows["AAC"]["sources"]) == 4
    assert {(s["dataset"], s["split"]) for s in rows["GG"]["sources"]} == {("one", "test"), ("two", "test")}
    fasta = "".join(p.read_text() for p in (tmp_path / "out" / "fasta").glob("part-*"))
    assert f">{rows['GG']['sequence_id']}\nGG\n" in fasta and fasta.count(">") == 2
    assert spark.read.csv(str(tmp_path / "out" / "csv"), header=True).count() == 2
    assert len(list((tmp_path / "out" / "fold_jobs").glob("name=*"))) == 2
    with pytest.raises(ValueError, match="no config"):
        registry.run(spark, [tmp_path / "three.yaml"], str(tmp_path / "none"))


def test_configs_choose_alert_rules(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("rule_set_name,description,smarts,max,priority\nown,number,[0-9]{9},0,3\nown,oxygen,O,0,1\nother,carbon,C,0,9\n")
    (tmp_path / "d.csv").write_text("smiles,y,split\nCO,1,train\nCN,0,valid\nCC 123456789,1,test\n")
    text = f"type: tabular\nname: a\ntask: classification\npath: {tmp_path}/d.csv\nout: {tmp_path}/out\ninfo:\n  alerts:\n    path: {tmp_path}/rules.csv\n    set: own\n"
    (tmp_path / "c.yaml").write_text(text)
    folder = cli.run_one(spark, tmp_path / "c.yaml", tmp_path)
    header, *rows = (folder / "records.csv").read_text().splitlines()
    at = header.split(",").index("n_warnings")
    assert sorted(r.rsplit(",", len(header.split(",")) - at)[1] for r in rows) == ["0", "1", "1"]
    (tmp_path / "c.yaml").write_text(text + "    min_priority: 2\n    without: [none]\n")
    assert cli.run_one(spark, tmp_path / "c.yaml", tmp_path) == folder  # it is whole, so it is left alone
    assert json.loads((folder / "manifest.json").read_text())["files"].keys() == {"records.csv", "summary.json"}
    (folder / "records.csv").unlink()
    cli.run_one(spark, tmp_path / "c.yaml", tmp_path)
    assert "number" in (folder / "records.csv").read_text() and "oxygen" not in (folder / "records.csv").read_text()


def test_a_folder_without_configs_is_an_error(tmp_path, caplog):
    assert cli.main(["--configs", str(tmp_path)]) == 1 and "no configs found" in caplog.text
    assert registry.main(["--configs", str(tmp_path), "--out", str(tmp_path)]) == 1
