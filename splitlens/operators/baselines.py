"""Baseline models: Spark ML's, and own ones where Spark has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.operators import boosting, networks
from splitlens.operators.metrics import average_precision, regression_metrics, roc_auc

TREES, MOST_CLASSES = 500, 10


def infer_task(records: DataFrame, configured: str | None = None) -> str:
    """Configured, or classification if labels are 0 and 1 only."""
    if configured in ("classification", "regression"):
        return configured
    x = F.col("label_num")[0]
    r = records.agg(F.countDistinct(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.bool_and(x.isin(0.0, 1.0)).alias("binary")).first()
    return "classification" if r.binary and r.n <= MOST_CLASSES else "regression"


def features(records: DataFrame, fp_bits: int = 2048, columns: list[str] | None = None) -> DataFrame:
    """``features`` from ``fp`` (a sparse vector; absent: of zeros), else from numeric columns; and ``y``."""
    from pyspark.ml.feature import CountVectorizerModel, VectorAssembler

    y = records.withColumn("y", F.col("label_num")[0]).where("y is not null")
    if columns is None and "fp" in records.columns:
        bits = F.transform(F.coalesce("fp", F.array().cast("array<int>")), lambda b: b.cast("string"))
        sparse = CountVectorizerModel.from_vocabulary([str(i) for i in range(fp_bits)], inputCol="__bits", outputCol="features").setBinary(True)
        return sparse.transform(y.withColumn("__bits", bits)).drop("__bits")
    names = columns or [c for c, kind in records.dtypes if kind in ("double", "float", "int", "bigint") and c not in ("row_id", "y", "id", "n_warnings")]
    filled = y.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(names)])
    return VectorAssembler(inputCols=[f"__x{i}" for i in range(len(names))], outputCol="features").transform(filled)


def _models(task: str, seed: int, trees: int, width: int, classes: int) -> dict:
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r
    from pyspark.ml.feature import StandardScaler

    common = {"labelCol": "y", "featuresCol": "features", "seed": seed}
    if task == "classification":
        scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=False)
        return {
            "random_forest": c.RandomForestClassifier(numTrees=trees, **common),
            "mlp": Pipeline(stages=[scaled, c.MultilayerPerceptronClassifier(layers=[width, *networks.HIDDEN, classes], maxIter=300, **common | {"featuresCol": "scaled"})]),
            "gradient_boosting": None,
        }
    return {"random_forest": r.RandomForestRegressor(numTrees=trees, **common), "mlp": None, "gradient_boosting": None}


def run_baselines(records: DataFrame, task: str | None = None, *, seed: int | None = None, trees: int = TREES, models: tuple[str, ...] | None = None, columns: list[str] | None = None, fp_bits: int = 2048, iterations: int = networks.ITERATIONS, rounds: int = boosting.ROUNDS) -> dict:
    """Train on train and valid, predict test: ``{task, models: {name: {metrics, predictions}}}``; all models unless some are
    named."""
    from pyspark.ml.functions import vector_to_array

    splits = {r[0] for r in records.select("split").distinct().collect()}
    if not {"train", "test"} <= splits:
        raise ValueError("baselines need train and test")
    if records.where(F.size("label_num") > 1).head(1):
        raise NotImplementedError("baselines take one label")
    task = infer_task(records, task)
    table = features(records, fp_bits, columns)
    train, test = table.where("split in ('train', 'valid')"), table.where("split = 'test'")
    width = len(train.select("features").first()["features"])
    out: dict = {"task": task, "models": {}}
    classes = int(train.agg(F.max("y")).first()[0] or 0) + 1 if task == "classification" else 1
    for name, model in _models(task, seed or 0, trees, width, max(2, classes)).items():
        if models is not None and name not in models:
            continue
        listed = lambda df: df.withColumn("features", vector_to_array("features")).select("row_id", "features", "y")
        if name == "gradient_boosting":
            predicted = boosting.fit(listed(train), task, rounds, seed=seed or 0).predicted(listed(test))
        elif model is None:  # Spark has no network for numbers
            predicted = networks.fit(listed(train), task, seed=seed or 0, iterations=iterations).predicted(listed(test))
        else:
            predicted = model.fit(train).transform(test)
        score = vector_to_array("probability")[1] if task == "classification" and model is not None else F.col("prediction")
        scored = predicted.select("row_id", "y", score.alias("score"))
        if task == "classification":
            metrics = roc_auc(scored).first().asDict() | average_precision(scored).first().asDict()
        else:
            metrics = regression_metrics(scored).first().asDict()
        out["models"][name] = {"metrics": metrics, "predictions": scored}
    return out
