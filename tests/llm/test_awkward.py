"""Every operator and every stage on awkward tables: clashing columns, nulls, empty and repeated rows, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from splitlens.llm import bloom_cascade, debruijn, decontamination, impact_topk, language_id, license_scan, line_dedup, line_quality, packing, partenum, queries, token_store

#: Names that operators use inside, or that differ from the columns asked for by case alone.
CLASHES = ["__key", "__id", "__gone", "__rk", "__hit_words", "__hit_spans", "__hit_mine", "__n_lines", "__n_removed", "rk", "c0", "c1", "gone", "mark", "spans", "hits", "words", "key", "host", "n", "TEXT", "Doc_Id"]

TEXTS = [None, "", "   ", "one", "a line of words that is said again\nand one more of eight words or so here", "a line of words that is said again\nother", "é中文 x\x00y", "word " * 400, "word " * 400]


def awkward(spark, extra="string"):
    rows = [(i, t, "xx" if i % 2 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)] + [(3, "one", "xx", "s1", 3)] * 2 + [(None, "a row without an id", None, None, 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [*docs.columns, *CLASHES]
    return docs.select("*", *[F.lit(f"own {c}").alias(f"x{i}") for i, c in enumerate(CLASHES)]).toDF(*names)


def bench(spark):
    return spark.createDataFrame([(1, "a row without an id"), (2, None)], "item_id long, text string")


def model(docs):
    return language_id.fit(docs)


PASSING = {
    "lines": lambda spark, d: line_dedup.dedup_lines(d),
    "lines, emptied": lambda spark, d: line_dedup.dedup_lines(d, drop_emptied=True),
    "near copies": lambda spark, d: partenum.one_of_each(d),
    "benchmark": lambda spark, d: decontamination.decontaminate(d, bench(spark)),
    "benchmark spans": lambda spark, d: decontamination.decontaminate(d, bench(spark), mode="spans"),
    "benchmark hits": lambda spark, d: decontamination.hit_spans(d, bench(spark)),
    "quality": lambda spark, d: line_quality.scored(d, line_quality.fit(d, spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, quality int"))),
    "languages": lambda spark, d: language_id.accepted(d, model(d), host="source"),
    "urls": lambda spark, d: bloom_cascade.filter_urls(d, queries.URL_RULES, spark.createDataFrame([("one",)], "key string"), url_col="text"),
}


@pytest.mark.parametrize("name", PASSING)
def test_columns_pass_through_whatever_their_names(spark, name):
    docs = awkward(spark)
    out = PASSING[name](spark, docs)
    kept = [c for c in docs.columns if name != "urls" or c.lower() not in ("host", "path", "rule", "verdict")]
    assert out.columns[: len(kept)] == kept
    rows = out.collect()
    for r in rows:
        own = dict(zip(kept, tuple(r), strict=False))
        assert all(own[c] == f"own {c}" for c in CLASHES if c in own)
    assert len(rows) == docs.count() or name in ("lines, emptied", "near copies", "benchmark", "languages")
    assert PASSING[name](spark, docs.limit(0)).count() == 0


GIVING = {
    "packing": (lambda d: packing.packed(d, queries.vocabulary()), None),
    "components": (lambda d: partenum.similar_components(d), 1),
    "store": (lambda d: token_store.digests(token_store.write(d, queries.vocabulary())), 1),
    "licenses": (lambda d: license_scan.scan(d), 1),
    "languages": (lambda d: language_id.judged(d, model(d), declared="lang", host="source"), 1),
    "substrings": (lambda d: debruijn.dedup_substrings(d, window=5, anchor=2), 1),
    "repeated lines": (lambda d: line_dedup.repeated_lines(d), None),
}


@pytest.mark.parametrize("name", GIVING)
def test_results_of_awkward_rows(spark, name):
    run, each = GIVING[name]
    docs = awkward(spark)
    found = run(docs).collect()
    if each:
        assert len(found) == docs.count()
    if name != "repeated lines":
        assert {r.doc_id for r in found} == {*range(len(TEXTS)), None}
    assert run(docs.limit(0)).count() == 0


def test_vectors_with_clashing_columns(spark):
    rows = [(i, [float(i), 1.0], "own") for i in range(120)] + [(50, None, "own"), (None, [1.0, 2.0], "own")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").toDF("vec_id", "embedding", "EMBEDDING")
    found = impact_topk.top_k(impact_topk.build(v), v.where(F.col("vec_id") % 50 == 0), 2).collect()
    assert sorted((r.query_id, r.vec_id) for r in found if r["rank"] == 1) == [(0, 1), (50, 119), (100, 119)]


@pytest.mark.parametrize("stage", pipeline.STAGES, ids=[n for n, _ in pipeline.STAGES])
def test_stages_on_awkward_tables(spark, stage):
    name, run = stage
    docs = awkward(spark)
    out = run(spark, docs, "/root/testdata/sf0.001")
    if name != "packing":
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert 0 < out.count() <= docs.count()
    assert run(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_a_corpus_without_labels_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = dict(pipeline.STAGES)["language ID"](spark, docs, "/root/testdata/sf0.001")
    assert kept.exceptAll(docs).count() == 0 and kept.count() == docs.count()
