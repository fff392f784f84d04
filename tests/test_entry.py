import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_folder():
    for p in (ROOT / "splitlens").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("splitlens.llm") or n == "corpus_pipeline" for n in names)


def test_streaming_contamination(spark, tmp_path):
    from splitlens.streaming.incremental import contaminated, contamination_counts

    rows = [("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00"), ("a", "2024-01-01 02:10:00"), ("z", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "entity string, at string").selectExpr("entity", "cast(at as timestamp) as at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, at timestamp").parquet(str(tmp_path / "in"))
    ref = spark.createDataFrame([("a",), ("a",), (None,)], "entity string")
    for name, df, mode in (("hits", contaminated(stream, ref), "append"), ("counts", contamination_counts(stream, ref, "at"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("hits").count() == 2
    assert sorted((r.n, r.n_contaminated) for r in spark.table("counts").collect()) == [(1, 0), (1, 1), (2, 1)]


def test_each_contamination_is_emitted_once_in_any_order(spark, tmp_path):
    import random

    from splitlens.plans import queries
    from splitlens.streaming.incremental import files, newly_contaminated

    sf = "/root/testdata/sf0.001"
    docs = [(r.entity, r.split) for r in queries.documents(spark, sf).select("entity", "split").collect()] * 2 + [(None, "train"), (None, "test")]
    want = queries.q_contamination_tv_test(spark, sf).first().n_contaminated
    assert want > 0
    for seed in range(2):
        random.Random(seed).shuffle(docs)
        folder = tmp_path / str(seed)
        for k in range(3):
            spark.createDataFrame(docs[k::3], "entity string, split string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = newly_contaminated(files(spark, f"{folder}/in", maxFilesPerTrigger=1)).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/out")
        q.awaitTermination()
        found = [r.key for r in spark.read.parquet(f"{folder}/out").collect()]
        assert len(found) == len(set(found)) == want


def test_many_rules_equal_each_rule_alone(spark):
    import random

    from splitlens.operators import alerts

    assert alerts.needed(r"(?i)licensed under [a-z]+") == "licensed under " and alerts.needed("[0-9]{9,}") is None
    assert alerts.needed("ab(cd)+ef") == "ab" and alerts.needed("a|b") is None and alerts.needed(r"\p{L}+") is None and alerts.needed("x?yz") == "yz"
    r = random.Random(5)
    words = ["".join(r.choices("abcXYZ", k=3)) for _ in range(60)]
    patterns = [*words, "(?i)abc+a", "[0-9]{3}", "a.c", "(?:ab)+c", "x|ab", "b{2,}", "(a)(b)", r"\p{L}{9}", "É+", "(?i)é"]
    rules = alerts.RuleSet([alerts.Rule("s", str(i), p, i % 2, 0) for i, p in enumerate(patterns)])
    texts = [" ".join(r.choices([*words, "123", "abca ABCA", "éÉ"], k=r.randint(0, 12))) for _ in range(80)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {x.i: list(x.warnings) for x in alerts.screen(df, "text", rules).collect()}
    for k in range(0, len(patterns), alerts.FEW):
        part = {x.i: list(x.warnings) for x in alerts.screen(df, "text", alerts.RuleSet(rules.rules[k : k + alerts.FEW])).collect()}
        assert part == {i: [n for n in names if k <= int(n) < k + alerts.FEW] for i, names in got.items()}
    assert any(got.values())
