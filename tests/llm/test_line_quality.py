"""The field's sums against enumeration, its slope against differences, and its scores on held-out and awkward texts."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitlens.llm import line_quality as lq
from splitlens.llm.textscan import WHITESPACE, scan

from .data import WORDS


def by_enumeration(potential, step, cuts):
    p, moves = np.zeros(len(potential)), np.zeros((2, 2))
    for a, b in itertools.pairwise(cuts):
        total, on, steps = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            weight = np.exp(sum((0.5 if y else -0.5) * potential[a + i] for i, y in enumerate(labels)) + sum(step[x, y] for x, y in itertools.pairwise(labels)))
            total += weight
            on += weight * np.array(labels)
            for x, y in itertools.pairwise(labels):
                steps[x, y] += weight
        if b > a:
            p[a:b], moves = on / total, moves + steps / total
    return p, moves


@pytest.mark.parametrize("seed", range(4))
def test_marginals_and_expected_steps_equal_enumeration(seed):
    r = np.random.default_rng(seed)
    cuts = np.concatenate([[0], np.cumsum(r.integers(0, 7, 9))])
    potential, step = r.normal(0, 2, cuts[-1]), r.normal(0, 1, (2, 2))
    p, moves = lq.marginals(potential, step, cuts)
    expected, steps = by_enumeration(potential, step, cuts)
    assert np.allclose(p, expected) and np.allclose(moves, steps)


def test_slope_of_the_fit_is_that_of_the_likelihood():
    r = np.random.default_rng(5)
    cuts, x = np.array([0, 4, 4, 9, 10]), r.normal(size=(10, 3))
    labels, weight, step = r.integers(0, 2, 10), r.normal(size=3), r.normal(size=(2, 2))
    p, expected = lq.marginals(x @ weight, step, cuts)
    seen = np.zeros((2, 2))
    for a, b in itertools.pairwise(cuts):
        for i in range(a + 1, b):
            seen[labels[i - 1], labels[i]] += 1
    slope, of_steps, tiny = x.T @ (labels - p), seen - expected, 1e-5
    value = lambda w, s: lq.log_likelihood(x @ w, s, cuts, labels)
    for k in range(3):
        d = np.eye(3)[k] * tiny
        assert np.isclose((value(weight + d, step) - value(weight - d, step)) / (2 * tiny), slope[k], atol=1e-4)
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = tiny
        assert np.isclose((value(weight, step + d) - value(weight, step - d)) / (2 * tiny), of_steps[i, j], atol=1e-4)


def test_chains_of_any_length_and_strong_potentials_stay_finite():
    potential = np.where(np.arange(200_000) % 2, 80.0, -80.0)
    p, moves = lq.marginals(potential, np.array([[3.0, -3.0], [-3.0, 3.0]]), np.array([0, 200_000]))
    assert np.isfinite(p).all() and np.isclose(moves.sum(), 199_999)


def features(*texts):
    out = [lq.line_features(s) for s in scan(pa.array(texts), WHITESPACE)]
    return np.concatenate([x for x, _, _ in out]), np.concatenate([n for _, n, _ in out])


def test_features_of_lines():
    x, size = features("SHOUT LOUD!! now\n\n  \nplain words here, yes.\nplain words here, yes.", None, "", " \n ", "a a a a")
    at = {n: i for i, n in enumerate(lq.NAMES)}
    assert len(x) == 4 and size.tolist() == [16, 22, 22, 7]
    assert np.isclose(x[0, at["words in capitals"]], 2 / 6) and np.isclose(x[0, at["capitals"]], 9 / 16)
    assert np.isclose(x[0, at["words that end in a mark"]], 1 / 6)
    assert x[:, at["line said before"]].tolist() == [0, 0, 1, 0]
    assert np.isclose(x[3, at["same word twice"]], 3 / 7) and np.isclose(x[3, at["different words"]], 1 - 3 / 7)


def corpus(n=160, seed=3):
    """Good prose in lines; bad: shouting, lists, repetition, half of the bad ones with a good line first."""
    r = random.Random(seed)
    line = lambda k=9: " ".join(r.choices(WORDS, k=k)).capitalize() + "."
    rows, marks = [], []
    for i in range(n):
        good = i % 3 != 0
        text = [line() for _ in range(r.randint(1, 8))]
        if not good:
            bad = r.choice([lambda: line(4).upper() + "!! &&", lambda: " | ".join(r.choices(WORDS, k=6)), lambda: (r.choice(WORDS) + " ") * 9])
            text = ([line()] if i % 2 else []) + [bad() for _ in range(r.randint(3, 9))]
        rows.append((i, "\n".join(text)))
        marks.append((i, int(good)))
    return rows, marks


def test_held_out_documents_and_their_lines(spark):
    rows, marks = corpus()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    model = lq.fit(docs.where("doc_id % 4 != 0"), labels)
    found = {r.doc_id: r for r in lq.scored(docs, model).collect()}
    truth = dict(marks)
    assert all((found[i][lq.SCORE] >= 0.3) == truth[i] for i in truth if i % 4 == 0)
    mixed = lq.scored(spark.createDataFrame([(0, rows[1][1].split("\n")[0] + "\n" + "\n".join(["ALPHA BETA GAMMA!! &&"] * 6))], "doc_id long, text string"), model).first()
    assert mixed[lq.LINES] == 7 and mixed[lq.BAD] >= 6
    again = lq.fit(docs.where("doc_id % 4 != 0").repartition(7), labels.repartition(3))
    assert np.array_equal(again.weight, model.weight) and again.curve == model.curve
    alone = lq.scored(docs.where("doc_id = 8"), model).first()[lq.SCORE]
    assert alone == found[8][lq.SCORE]  # whatever else is scored with it


def test_only_text_counts(spark):
    rows, marks = corpus(40)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    one = spark.createDataFrame([(i, t, "de", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    model = lq.fit(one, labels)
    other = one.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("fr").alias("lang"), F.lit("b").alias("source"))
    assert sorted(r[lq.SCORE] for r in lq.scored(one, model).collect()) == sorted(r[lq.SCORE] for r in lq.scored(other, model).collect())


def test_awkward_texts_and_labels(spark):
    rows, marks = corpus(60)
    long_text = "\n".join(t for _, t in rows) * 150  # 1.5 MB, some 40,000 lines
    long_line = "word " * 200_000
    extra = [(900, None), (901, ""), (902, " \n \t"), (903, "x"), (904, long_text), (905, long_line), (906, "twice"), (906, "twice"), (None, "no id"), (907, "é中文\x00 \r\n\x0b")]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("good", "s", "n", "b", "TEXT", "c0", lq.SCORE)])
    labels = spark.createDataFrame([*marks, (900, 0), (901, 1), (902, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    model = lq.fit(docs, labels)
    assert model.empty == (2 + 1) / (3 + 2)
    out = lq.scored(docs, model)
    assert out.columns == [*docs.columns, lq.SCORE, lq.LINES, lq.BAD]
    found = out.toDF(*[f"k{i}" for i in range(len(out.columns))]).select("k0", f"k{len(out.columns) - 3}", f"k{len(out.columns) - 2}").collect()
    assert len(found) == len(rows) + len(extra) and all(0 <= r[1] <= 1 for r in found)
    by_id = {r[0]: r[1:] for r in found}
    assert by_id[900] == by_id[901] == by_id[902] == (model.empty, 0)
    assert by_id[905][1] == 1 and by_id[904][1] > 30_000
    none = lq.fit(docs, labels.limit(0))
    assert none.weight is None and {r[0] for r in lq.scored(docs, none).select(F.expr(f"`{lq.LINES}`")).collect()} == {0}
    assert lq.scored(docs.limit(0), model).count() == 0
    assert lq.fit(docs.limit(0), labels).weight is None
    one = lq.fit(docs, labels.where("quality = 1"))
    assert one.weight is None and one.empty > 0.9


def test_sampled_lines_are_a_run_from_a_place_of_the_texts_own(spark):
    rows = [(1, 0, "\n".join(f"line {i} of many" for i in range(1000))), (2, 1, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, quality int, text string")
    got = docs.select("text", F.col("quality").alias("good")).mapInArrow(lambda b: lq._sampled(b, 50), lq.FIT_ROW).collect()
    assert sorted(len(r.sizes) for r in got) == [1, 50]
