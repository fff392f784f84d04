"""Config settings, splitting, optional sources, exports and the set join, with own fixtures."""

import json
import random
import sys
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitlens import cli, sinks
from splitlens.config import AuditConfig, audit_config, output_dir, slug, validated
from splitlens.functions.similarity import indel_ratio_of
from splitlens.operators import blocks, neighbors, similarity, splitters
from splitlens.plans import queries
from splitlens.sources import records as rec
from splitlens.sources.structures import read_hits, read_registry


def sides_by_rule(sizes, seed=123, a=0.8, b=0.1):
    """Groups shuffled, largest first; whole into train, else valid, else test, by cuts that aren't rounded."""
    order = np.arange(len(sizes))
    np.random.RandomState(seed).shuffle(order)
    total, train, valid, out = sum(sizes), 0, 0, {}
    for g in sorted(order, key=lambda g: -sizes[g]):
        if train + sizes[g] <= a * total:
            out[g], train = "train", train + sizes[g]
        elif train + valid + sizes[g] <= (a + b) * total:
            out[g], valid = "valid", valid + sizes[g]
        else:
            out[g] = "test"
    return [out[g] for g in range(len(sizes))]


@pytest.mark.parametrize("n,want", [(19, (15, 2, 2)), (23, (18, 2, 3)), (10, (8, 1, 1)), (1, (0, 0, 1))])
def test_cuts_are_of_the_sum_of_fractions(spark, n, want):
    df = spark.range(n).withColumnRenamed("id", "row_id").withColumn("g", F.concat(F.lit("g"), "row_id"))
    for out in (splitters.random_split(df), splitters.group_split(df, "g")):
        found = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
        assert tuple(found.get(s, 0) for s in splitters.NAMES) == want


def test_group_sides_follow_the_rule(spark):
    r = random.Random(2)
    for _ in range(20):
        sizes = [r.randint(1, 9) for _ in range(r.randint(1, 40))]
        assert splitters.assign_groups(sizes) == sides_by_rule(sizes)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_brand").orderBy("p_partkey").collect()
    firsts = list(dict.fromkeys(x.p_brand for x in part))
    sides = dict(zip(firsts, sides_by_rule([sum(x.p_brand == b for x in part) for b in firsts]), strict=True))
    want = {s: (sum(sides[x.p_brand] == s for x in part), sum(v == s for v in sides.values())) for s in sides.values()}
    assert {r.split: (r.n, r.groups) for r in queries.q_group_split(spark, "/root/testdata/sf0.001").collect()} == want
    order = np.arange(len(part))
    np.random.RandomState(123).shuffle(order)
    cut = [0, int(0.8 * len(part)), int((0.8 + 0.1) * len(part)), len(part)]
    keys = [x.p_partkey for x in part]
    want = {s: sum(keys[i] for i in order[cut[k] : cut[k + 1]]) for k, s in enumerate(splitters.NAMES)}
    assert {r.split: r["keys"] for r in queries.q_random_split(spark, "/root/testdata/sf0.001").collect()} == want


def test_label_columns_fractions_and_fallbacks():
    base = {"type": "tabular", "path": "a.csv", "task": "classification"}
    assert audit_config(base | {"info": {"label_cols": " y "}}).label_cols == ["y"]
    assert audit_config(base | {"info": {"label_cols": ("y", 2)}}).label_cols == ["y", "2"]
    assert audit_config(base | {"info": {"label_cols": ""}}).label_cols == []
    with pytest.raises(TypeError):
        validated(base | {"info": {"label_cols": 7}})
    for bad, error in (("0.8", TypeError), ([0.8, 0.2], ValueError), ([0.8, -0.1, 0.3], ValueError), ([0, 0, 0], ValueError)):
        with pytest.raises(error):
            validated(base | {"info": {"split_fracs": bad}})
    c = audit_config(base | {"sim_threshold": 0.7, "data_path": "d/", "info": {"split_fracs": [1, 1, 2], "split_method": "scaffold", "keep_invalid": False}})
    assert (c.threshold, c.data_path, c.split_fracs, c.split_method, c.split_seed, c.keep_invalid) == (0.7, "d/", [1.0, 1.0, 2.0], "scaffold", 123, False)
    assert audit_config(base | {"type": "dti"}).info["keep_invalid"] is True
    assert validated({"paths": {"train": "a", "valid": "b", "test": "c", "more": "d"}})["paths"] == {"train": "a", "valid": "b", "test": "c"}


@pytest.mark.parametrize("text,want", [(" A/b  c ", "A-b-c"), ("--a--b--", "a-b"), ("..", None), ("", None), ("x_1.2-3", "x_1.2-3"), ("-.a.-", "a"), ("é", None)])
def test_slugs(spark, text, want):
    from splitlens.functions.labels import slug as column_slug

    assert slug(text) == want == spark.range(1).select(column_slug(F.lit(text)).alias("s")).first().s


def test_output_places(tmp_path):
    (tmp_path / "configs/tdc").mkdir(parents=True)
    c = tmp_path / "configs/tdc/x.yaml"
    top = tmp_path / "configs"
    assert output_dir({"name": "n"}, tmp_path / "runs", c, top) == tmp_path / "runs/tdc/n"
    assert output_dir({"name": "n", "out": "elsewhere"}, tmp_path / "runs", c, top) == tmp_path / "runs/tdc/n"
    assert output_dir({"name": "n", "out": str(tmp_path / "o/tdc")}, "runs", c, top) == tmp_path / "o/tdc/n"
    assert output_dir({"name": "n", "out": str(tmp_path / "o")}, "runs", c, top) == tmp_path / "o/tdc/n"
    assert output_dir({"type": "T d"}, tmp_path, tmp_path / "q.yml", top) == tmp_path / "T-d/q"
    assert output_dir({"task": "classification"}, tmp_path).parts[-2:] == ("unknown", "classification")


def test_a_table_without_splits_is_split_by_method(spark, tmp_path):
    rows = "\n".join(f"C{'C' * (i % 40)}N{i},{i % 2}" for i in range(60))
    (tmp_path / "d.csv").write_text("smiles,label\n" + rows + "\n")
    (tmp_path / "c.yaml").write_text(f"type: tabular\nname: m\ntask: classification\npath: {tmp_path}/d.csv\nout: {tmp_path}/out\ninfo:\n  split_method: random\n  split_fracs: [0.5, 0.25, 0.25]\n")
    folder = cli.run_one(spark, tmp_path / "c.yaml", tmp_path)
    assert json.loads((folder / "summary.json").read_text())["counts"] == {"train": 30, "valid": 15, "test": 15}
    config = AuditConfig("classification", path=str(tmp_path / "d.csv"))
    with pytest.raises(KeyError, match="split"):
        rec.load(spark, config)
    with pytest.raises(ValueError, match="unknown split"):
        rec.load(spark, AuditConfig("classification", path=str(tmp_path / "d.csv"), split_method="odd"))


class Part:
    def __init__(self, inputs, targets):
        self.inputs, self.targets = inputs, targets


def test_optional_sources_by_stubs(spark, monkeypatch):
    asked = []

    class Tox:
        def __init__(self, name, path):
            asked.append((name, path))
            if name != "known":
                raise RuntimeError("no such set")

        def get_split(self, **options):
            asked.append(options)
            frame = lambda s, n: pd.DataFrame({"Drug_ID": [f"{s}{i}" for i in range(n)], "Drug": ["C" * (i + 1) for i in range(n)], "Y": [i % 2 for i in range(n)]})
            return {"train": frame("a", 6), "valid": frame("b", 2), "test": frame("c", 3)}

    def absent(name, path):
        raise RuntimeError("not here")

    monkeypatch.setitem(sys.modules, "tdc", types.ModuleType("tdc"))
    monkeypatch.setitem(sys.modules, "tdc.single_pred", types.SimpleNamespace(ADME=absent, Tox=Tox, HTS=absent, QM=absent))
    t = rec.load(spark, audit_config({"type": "tdc", "name": "known", "task": "classification", "data_path": "here/", "info": {"split": "scaffold"}}))
    assert {r.split: r["count"] for r in t.groupBy("split").count().collect()} == {"train": 6, "valid": 2, "test": 3}
    rec.load(spark, audit_config({"type": "tdc", "name": "known", "task": "classification"}))
    assert asked == [("known", "here/"), {"method": "scaffold"}, ("known", "data/tdc/"), {}]
    with pytest.raises(ValueError, match="ADME"):
        rec.load(spark, audit_config({"type": "tdc", "name": "other", "task": "classification"}))

    hub = types.SimpleNamespace(load_benchmark=lambda name: types.SimpleNamespace(get_train_test_split=lambda: (Part(["CC", "CN"], [0.5, 1.5]), Part(["CO"], None))))
    monkeypatch.setitem(sys.modules, "polaris", hub)
    t = rec.load(spark, audit_config({"type": "polaris", "name": "x/y", "task": "regression"})).orderBy("split", "row_id").collect()
    assert [(r.split, r.id, r.entity, r.label_num) for r in t] == [("test", "0", "CO", [None]), ("train", "0", "CC", [0.5]), ("train", "1", "CN", [1.5])]


def test_registry_hits_and_exports(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"sequence_id": "s1", "sequence": "MKV"}\n{"sequence_id": "", "sequence": "AAA"}\n')
    (tmp_path / "h.m8").write_text("s1\ts2\t0.9\t10\t1\t0\t1\t10\t1\t10\t1e-5\t99\t0.8\n")
    registry = read_registry(spark, str(tmp_path / "r.jsonl"))
    assert [(r.sequence_id, r.sequence) for r in registry.collect()][:1] == [("s1", "MKV")]
    hits = read_hits(spark, str(tmp_path / "h.m8")).collect()
    assert len(hits) == 1 and (hits[0].query, hits[0].target) == ("s1", "s2")
    sinks.write_fasta(registry, str(tmp_path / "f"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*"))) == ">s1\nMKV\n"
    sinks.write_sequences_csv(registry, str(tmp_path / "s"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*"))).split() == ["id,sequence", "s1,MKV"]
    sinks.write_fold_jobs(registry.where("sequence_id <> ''"), str(tmp_path / "jobs"), (1, 2))
    (job,) = (tmp_path / "jobs/name=s1").glob("part-*")
    job = json.loads(job.read_text())
    assert job["name"] == "s1" and job["modelSeeds"] == [1, 2] and job["sequences"][0]["protein"]["sequence"] == "MKV"


def test_results_are_one_file_or_a_folder_as_asked(spark, tmp_path):
    rows = spark.range(50, numPartitions=3).selectExpr("id", "array(id, null) as a")
    assert [json.loads(x)["id"] for x in sinks.write_rows(rows, tmp_path / "r.jsonl").read_text().splitlines()] == list(range(50))
    sinks._at(tmp_path / "r.jsonl")[1].delete(sinks._at(tmp_path / "r.jsonl")[0], True)
    assert sinks.write_rows(rows, tmp_path / "r.jsonl", False).is_dir() and spark.read.json(str(tmp_path / "r.jsonl")).count() == 50
    named = rows.selectExpr("id", "concat('a,\"b ', id) as `x y`", "a")
    text = sinks.write_records(named, tmp_path / "one.csv").read_text().splitlines()
    assert len(text) == 51 and text[0] == "id,x y,a" and sum(x.startswith("id,") for x in text) == 1
    sinks.write_records(named, tmp_path / "many.csv", False)
    for path in ("one.csv", "many.csv"):
        back = spark.read.csv(str(tmp_path / path), header=True, escape='"')
        assert back.columns == ["id", "x y", "a"] and sorted(int(r.id) for r in back.collect()) == list(range(50)) and back.where("id = 7").first()["x y"] == 'a,"b 7'
    assert sinks.write_rows(rows.limit(0), tmp_path / "none.jsonl") is None


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9])
def test_scan_and_prefixes_give_the_same_pairs(spark, threshold, monkeypatch):
    r = random.Random(7)
    sets = [(f"x{i}", sorted(r.sample(range(70), r.choice([0, 1, 2, 20, 35, 35, 35, 50])))) for i in range(120)] + [("none", None)]
    sets += [(f"y{i}", sorted(set(sets[i][1]) ^ {r.randrange(70)})) for i in range(60)]
    df = spark.createDataFrame(sets, "id string, bits array<int>")
    want = {}
    for a, x in sets:
        for b, y in sets:
            if a < b and x is not None and y is not None:
                both = len(set(x) & set(y))
                s = both / (len(x) + len(y) - both) if x or y else 1.0
                if s >= threshold:
                    want[a, b] = s
    rows = lambda found: sorted((p.a, p.b, p.similarity) for p in found.collect())
    expected = sorted((a, b, s) for (a, b), s in want.items())
    for way in ("prefix", "scan", None):
        assert rows(similarity.tanimoto_pairs(df, threshold, way)) == expected
    monkeypatch.setattr(blocks, "BLOCK_SETS", 17)
    monkeypatch.setattr(blocks, "PRODUCT", 500)
    assert rows(similarity.tanimoto_pairs(df, threshold, "scan")) == expected
    assert similarity.tanimoto_pairs(df.limit(0), threshold).count() == 0
    numbers = df.where("bits is not null").withColumn("id", F.xxhash64("id"))
    assert similarity.tanimoto_pairs(numbers, threshold, "scan").where("a >= b").count() == 0


def test_size_blocks_hold_every_size_once():
    sizes = {0: 3, 1: 50, 2: 1, 3: 1, 7: 8, 9: 200}
    made = blocks.size_blocks(sizes, 10)
    assert [b.no for b in made] == list(range(len(made)))
    for size in sizes:
        own = [b for b in made if b.low <= size <= b.high]
        assert sorted(b.part for b in own) == list(range(own[0].parts)) and len(own) == own[0].parts


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_of_any_size_equal_brute_force(spark, seed, monkeypatch):
    """Sizes are far apart, so that some queries need wider bands; blocks are small, so that there are many."""
    r = random.Random(seed)
    one = lambda i: (i, r.choice([None, [], sorted(r.sample(range(90), r.choice([1, 2, 3, 8, 20, 40, 60, 85])))]))
    queries_, refs = [one(i) for i in range(60)], [one(i) for i in range(90)]
    refs += [(200 + i, x and x[:-1]) for i, x in queries_[:20]] + [(300, queries_[0][1])]
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
    want = {i: max(jac(x, y) for _, y in refs if y is not None) for i, x in queries_ if x is not None}
    q, ref = spark.createDataFrame(queries_, "id int, bits array<int>"), spark.createDataFrame(refs, "id int, bits array<int>")
    for most in (4096, 9):
        monkeypatch.setattr(blocks, "BLOCK_SETS", most)
        got = neighbors.nearest(q, ref, 64).collect()
        assert {x.id: x.similarity for x in got} == pytest.approx(want) and len(got) == len(want)
    assert neighbors.nearest(q, ref.limit(0), 64).count() == 0 == neighbors.nearest(q.limit(0), ref, 64).count()


def test_consensus_cliffs_equal_brute_force(spark):
    """At the size of its query: all part names, all three measures."""
    sf = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf}/part.parquet").collect()
    split = lambda k: "train" if k % 10 < 8 else "valid" if k % 10 < 9 else "test"
    names = sorted({p.p_name for p in part})
    similar = {}
    for a in names:
        for b in names:
            x, y = set(a), set(b)
            both = len(x & y)
            similar[a, b] = both / (len(x) + len(y) - both) >= 0.8 or indel_ratio_of(a, b) >= 0.8
    want = {}
    for p in part:
        for q in part:
            if p.p_brand == q.p_brand or not similar[p.p_name, q.p_name]:
                continue
            test = (split(p.p_partkey) == "test", split(q.p_partkey) == "test")
            rank = lambda r: (["train", "valid", "test"].index(split(r.p_partkey)), r.p_partkey)
            kind = "cross_tv_test" if test == (False, True) else None
            if test[0] == test[1] and p.p_name != q.p_name and rank(p) < rank(q):
                kind = "intra_test" if test[0] else "intra_tv"
            if kind:
                want[kind] = want.get(kind, 0) + 1
    assert {r.kind: r.n for r in queries.q_consensus_cliffs(spark, sf).collect()} == want


def test_a_result_that_lost_something_is_not_whole(spark, tmp_path):
    sinks.write_json({"a": 1}, tmp_path / "summary.json")
    sinks.write_rows(spark.range(9), tmp_path / "cliffs.jsonl")
    assert not sinks.is_done(tmp_path)
    sinks.write_manifest(tmp_path, ["summary.json", "cliffs.jsonl"])
    assert sinks.is_done(tmp_path) and not sinks.is_done(tmp_path, benchmark=True)
    whole = (tmp_path / "cliffs.jsonl").read_text()
    (tmp_path / "cliffs.jsonl").write_text(whole[:-4])
    (tmp_path / ".cliffs.jsonl.crc").unlink(missing_ok=True)
    assert not sinks.is_done(tmp_path)
    (tmp_path / "cliffs.jsonl").write_text(whole)
    assert sinks.is_done(tmp_path)
    (tmp_path / "manifest.json").write_text("{")
    (tmp_path / ".manifest.json.crc").unlink(missing_ok=True)
    assert not sinks.is_done(tmp_path)


@pytest.mark.parametrize("n", [0, 1, 7, 1003])
def test_exact_splits_have_the_sizes_of_the_random_split(spark, n, monkeypatch):
    import hashlib

    monkeypatch.setattr(splitters, "_FEW", 5)
    monkeypatch.setattr(splitters, "_DIGITS", 1)
    df = spark.range(n).withColumn("split", F.lit("old"))
    for fractions in ((0.8, 0.1, 0.1), (0.0, 0.5, 0.5), (1.0, 0.0, 0.0)):
        got = {r.id: r.split for r in splitters.exact_split(df, "id", fractions).collect()}
        order = sorted(range(n), key=lambda i: hashlib.md5(f"123:{i}".encode()).hexdigest())
        a, b = int(fractions[0] * n), int((fractions[0] + fractions[1]) * n)
        assert got == {i: "train" if k < a else "valid" if k < b else "test" for k, i in enumerate(order)}


@pytest.mark.parametrize("seed", range(3))
def test_group_walks_on_the_histogram_equal_the_walk_over_groups(spark, seed, monkeypatch):
    import hashlib

    monkeypatch.setattr(splitters, "_FEW", 3)
    monkeypatch.setattr(splitters, "_DIGITS", 1)
    r = random.Random(seed)
    groups = [(g if g else None, r.choice([1, 1, 1, 2, 2, 3, 5, 40])) for g in range(r.choice([1, 60, 200]))]
    rows = [(g, i) for g, n in groups for i in range(n)]
    got = splitters.hashed_group_split(spark.createDataFrame(rows, "g int, i int"), "g").collect()
    assert len(got) == len(rows)
    order = sorted(groups, key=lambda x: (-x[1], "" if x[0] is None else hashlib.md5(f"123:{x[0]}".encode()).hexdigest()))
    monkeypatch.setattr(splitters.np.random, "RandomState", lambda seed: types.SimpleNamespace(shuffle=lambda x: None))
    want = dict(zip([g for g, _ in order], splitters.assign_groups([n for _, n in order]), strict=True))
    assert {(x.g, x.split) for x in got} == set(want.items())


def test_auc_over_many_ranges(spark, monkeypatch):
    from splitlens.operators import metrics

    r = random.Random(4)
    rows = [(r.randint(0, 1), r.randint(0, 60) / 7) for _ in range(800)]
    df = spark.createDataFrame(rows, "y int, score double")
    whole = (metrics.roc_auc(df).first()[0], metrics.average_precision(df).first()[0])
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert whole[0] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))
    monkeypatch.setattr(metrics, "STEPS", 5)
    assert (metrics.roc_auc(df).first()[0], metrics.average_precision(df).first()[0]) == pytest.approx(whole)
    assert metrics.roc_auc(df.limit(0)).first()[0] is None


@pytest.mark.parametrize("threshold", [0.75, 0.8, 0.87, 0.9, 0.95, 1.0])
def test_string_candidates_lose_no_pair(spark, threshold):
    """Families with letters gone and put in, around the lengths where ways change; few letters, so that many segments are equal."""
    r = random.Random(11)
    names = set()
    for size in (1, 2, 3, 5, 8, 13, 20, 31, 33, 38, 45, 70):
        base = "".join(r.choices("ab c", k=size))
        for _ in range(7):
            own = list(base)
            for _ in range(r.randint(0, max(1, size // 8))):
                if own and r.random() < 0.5:
                    own.pop(r.randrange(len(own)))
                else:
                    own.insert(r.randint(0, len(own)), r.choice("ab cx"))
            names.add("".join(own))
    names = sorted(n for n in names if n)
    got = {(x.a, x.b): x.similarity for x in similarity.string_ratio_pairs(spark.createDataFrame([(n, n) for n in names], "id string, text string"), threshold).collect()}
    want = {(a, b): indel_ratio_of(a, b) for a in names for b in names if a < b and indel_ratio_of(a, b) >= threshold}
    assert got == want


def test_few_candidates_by_the_better_way(spark):
    r = random.Random(6)
    names = sorted({"".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(15, 36))) for _ in range(400)})
    names += sorted({x[:9] + x[10:] for x in names[:50]})
    df = spark.createDataFrame([(x, x) for x in names], "id string, text string")
    want = {(a, b) for a in names for b in names if a < b and indel_ratio_of(a, b) >= 0.9}
    for way in ("segments", "letters", None):
        assert want <= {(min(x.a, x.b), max(x.a, x.b)) for x in similarity.string_candidates(df, 0.9, way).collect()}
    assert similarity.string_candidates(df, 0.9).count() < 0.01 * len(names) ** 2 / 2
