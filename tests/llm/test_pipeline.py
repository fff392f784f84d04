import re
from collections import Counter

import numpy as np

import corpus_pipeline as pipeline
from splitlens.llm import queries
from splitlens.llm.common import saved
from tests.llm.test_operators import ALNUM, brute_lines, ids_of, low
from tests.llm.test_partenum import brute


def test_stages_equal_brute_force(spark, tmp_path):
    """Every stage on its own input, and packing of what is left, against plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = saved(stage(spark, docs, sf), "stage", keep=True)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        kept[name] = len(after)
        if name == "language ID":
            assert {i for i, t in before if len(t.split()) > 20} <= set(after)
        elif name == "line dedup":
            gone = brute_lines(before)
            want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in before}
            assert after == {i: t for i, t in want.items() if t.split() or t == dict(before)[i]}
        elif name == "n-gram Jaccard join":
            assert set(after) == {i for i, (_, c) in brute(before).items() if c == i}
        else:
            grams = set()
            for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
                w = ALNUM.findall(low(r.text))
                grams |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)}
            sizes = {len(g) for g in grams}
            hit = lambda t: any(tuple(w[k : k + n]) in grams for w in [ALNUM.findall(low(t))] for n in sizes for k in range(len(w) - n + 1))
            assert set(after) == {i for i, t in before if not hit(t)}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    pieces = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, text in texts.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert np.array_equal(np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4"), ids_of(t, text, 0))
    assert Counter(p.doc_id for p in pipeline.run(spark, sf).collect()) == Counter(p.doc_id for p in pieces)
    assert re.match("^[0-9]", str(kept["language ID"])) and kept["benchmark decontamination"] < kept["language ID"]
