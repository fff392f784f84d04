import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlens.operators import baselines, boosting, networks
from splitlens.plans import queries


def test_forest_query_uses_every_component_and_the_default_trees(spark, tmp_path, monkeypatch):
    """Labels follow the last component alone, which a prefix of the vector does not hold."""
    r = random.Random(4)
    rows = []
    for i in range(400):
        v = [r.random() for _ in range(12)]
        rows.append((i, v, int(10 * v[11])))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen, models = [], baselines._models
    monkeypatch.setattr(baselines, "_models", lambda task, seed, trees, width, classes: seen.append((trees, width)) or models(task, seed, trees, width, classes))
    found = queries.q_baseline_rf(spark, str(tmp_path)).first()
    assert seen == [(baselines.TREES, 12)]
    assert found.pearson > 0.9


@pytest.mark.parametrize("classes", [True, False])
def test_slopes_of_a_network_equal_differences(classes):
    r = np.random.default_rng(2)
    shape = networks.Shape((3, 5, 4, 3 if classes else 1), classes)
    theta, x = shape.start(1), r.normal(size=(7, 3))
    y = np.eye(3)[r.integers(0, 3, 7)] if classes else r.normal(size=(7, 1))
    slope = shape.slope(theta, x, y)[1:]
    for k in range(0, len(theta), 5):
        d = np.zeros_like(theta)
        d[k] = 1e-6
        assert np.isclose((shape.slope(theta + d, x, y)[0] - shape.slope(theta - d, x, y)[0]) / 2e-6, slope[k], atol=1e-4)


def test_networks_learn_and_do_not_depend_on_partitions(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 2)) * [1, 50]
    z = np.where(x[:, 0] > 0.5, 2.0, np.where(x[:, 1] > 0, 1.0, 5.0))
    rows = [([float(a), float(b)], float(100 + 30 * a * a), float(c)) for (a, b), c in zip(x, z, strict=True)]
    table = spark.createDataFrame(rows, "features array<double>, number double, kind double")
    of = lambda df, y: df.select("features", F.col(y).alias("y"))
    monkeypatch.setattr(networks, "FAN", 2)
    one = networks.fit(of(table.coalesce(1), "number"), "regression", (16,), 60)
    two = networks.fit(of(table.repartition(5), "number"), "regression", (16,), 60)
    assert np.allclose(one.theta, two.theta, atol=1e-6)
    got = one.predicted(of(table, "number")).collect()
    assert np.corrcoef([g.y for g in got], [g.prediction for g in got])[0, 1] > 0.95 and got[0].probabilities is None
    kinds = networks.fit(of(table, "kind"), "classification", (16,), 60)
    assert kinds.labels == [1.0, 2.0, 5.0]
    got = kinds.predicted(of(table, "kind")).collect()
    assert sum(g.y == g.prediction for g in got) > 270 and abs(sum(got[0].probabilities) - 1) < 1e-9
    with pytest.raises(ValueError):
        networks.fit(of(table.limit(0), "kind"), "classification")


def test_bits_become_sparse_vectors(spark):
    from splitlens.operators.baselines import features

    rows = spark.createDataFrame([(1, [0, 3, 7], [1.0]), (2, [], [0.0]), (3, None, [1.0])], "row_id long, fp array<int>, label_num array<double>")
    got = [r.features for r in features(rows, 8).orderBy("row_id").collect()]
    assert [list(g.toArray()) for g in got] == [[1, 0, 0, 1, 0, 0, 0, 1], [0] * 8, [0] * 8] and got[0].__class__.__name__ == "SparseVector"


def plain_boosting(x, y, edges, rounds, leaves, least_rows, classes, rate=0.05):
    """Leaf by leaf, each split searched over all rows of each leaf: predictions of the rows."""
    b = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1)
    m = np.full(len(y), np.log(y.mean() / (1 - y.mean())) if classes else y.mean())
    for _ in range(rounds):
        g, h = (1 / (1 + np.exp(-m)) - y, (1 / (1 + np.exp(-m))) * (1 - 1 / (1 + np.exp(-m)))) if classes else (m - y, np.ones(len(y)))
        ends = [np.arange(len(y))]
        while len(ends) < leaves:
            best = None
            for k, rows in enumerate(ends):
                for f in range(b.shape[1]):
                    for last in range(len(edges[f])):
                        lo = b[rows, f] <= last
                        if min(lo.sum(), (~lo).sum()) < least_rows or min(h[rows][lo].sum(), h[rows][~lo].sum()) < 1e-3:
                            continue
                        gain = round(sum(g[rows][s].sum() ** 2 / h[rows][s].sum() for s in (lo, ~lo)) - g[rows].sum() ** 2 / h[rows].sum(), 9)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = gain, k, rows[lo], rows[~lo]
            if best is None:
                break
            ends[best[1] : best[1] + 1] = best[2:]
        for rows in ends:
            m[rows] -= rate * g[rows].sum() / h[rows].sum()
    return 1 / (1 + np.exp(-m)) if classes else m


@pytest.mark.parametrize("classes", [True, False])
def test_boosted_trees_equal_a_plain_search_for_every_leaf(spark, monkeypatch, classes):
    r = np.random.default_rng(6)
    x = r.normal(size=(240, 3))
    number = 3 * np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + r.normal(size=240) / 5
    y = (number > 0.3).astype(float) if classes else number
    table = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "features array<double>, y double").repartition(3)
    monkeypatch.setattr(boosting, "KEPT", 2)  # margins are written in between
    model = boosting.fit(table, "classification" if classes else "regression", 5, leaves=7, share=1.0, bins=8, least_rows=10)
    assert len(model.trees) == 5 and all((t.feature >= 0).sum() <= 6 for t in model.trees)
    got = {tuple(p.features): p.prediction for p in model.predicted(table).collect()}
    want = plain_boosting(x, y, model.edges, 5, 7, 10, classes)
    assert np.allclose([got[tuple(v.tolist())] for v in x], want, atol=1e-6)


def test_boosting_takes_awkward_tables(spark):
    schema = "features array<double>, y double"
    with pytest.raises(ValueError):
        boosting.fit(spark.createDataFrame([], schema), "regression")
    with pytest.raises(ValueError):
        boosting.fit(spark.createDataFrame([([1.0], 2.0)], schema), "classification")
    few = spark.createDataFrame([([1.0, None], 2.0), ([1.0, 3.0], 4.0), ([5.0, 3.0], None)], schema)
    model = boosting.fit(few, "regression")  # too few rows for a split: the mean
    assert model.trees == [] and {p.prediction for p in model.predicted(few).collect()} == {3.0}
    gaps = spark.createDataFrame([([None if i % 2 else float(i)], float(i % 2)) for i in range(80)], schema)
    model = boosting.fit(gaps, "regression", 3)  # what is missing tells the number
    got = {p.y: p.prediction for p in model.predicted(gaps).collect()}
    assert len(model.trees) == 3 and got[1.0] > 0.55 and got[0.0] < 0.45
    assert len(boosting.quantile_edges(gaps.withColumn("features", F.array(F.rand(1))), 80, 8, 40)[0]) == 7  # from a share of the rows
