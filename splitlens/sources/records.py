"""Canonical records: one table with a ``split`` column, whatever the input's shape.

``split, row_id, id, entity, label_num, label_key`` and, where there are targets, ``target_seq, target_id``; other
columns are kept unless they have one of these names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlens.config import AuditConfig
from splitlens.functions.labels import sequence, split_name, with_labels
from splitlens.operators import splitters
from splitlens.operators.standardize import scaffold

#: Column names of each role, in order of preference.
CANDIDATES = {
    "entity": ["smiles", "SMILES", "drug", "Drug"],
    "label": ["label_raw", "label", "Label", "y", "Y"],
    "id": ["id", "ID", "compound_id", "compoundID"],
    "sequence": ["sequence_aa", "sequence", "Sequence", "protein_sequence", "ProteinSequence", "target_sequence", "TargetSequence", "AASequence"],
    "target_id": ["target_id", "target", "TargetID", "protein_id", "ProteinID"],
}
CANONICAL = ["split", "row_id", "id", "entity", "label_num", "label_key", "target_seq", "target_id"]


def resolve(columns: list[str], role: str, configured: str | None = None) -> str | None:
    """The configured column if it exists, else the first candidate by exact, then case-insensitive name."""
    if configured in columns:
        return configured
    for candidate in CANDIDATES[role]:
        if candidate in columns:
            return candidate
        for c in columns:
            if c.lower() == candidate.lower():
                return c
    return None


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV, TSV or Parquet by suffix; any other is refused before a plan is made."""
    name = path.lower().rstrip("/")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if not name.endswith((".csv", ".tsv")):
        raise ValueError(f"unsupported file type: {path}")
    reader = spark.read.option("header", True).option("sep", "\t" if name.endswith(".tsv") else ",").option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def numbered(df: DataFrame) -> DataFrame:
    """``row_id`` from 0 within each split, in the order as read. Rows are ranked within their partition; what the
    partitions before it hold comes from a table of a row per split and partition."""
    placed = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("split", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("split").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("split", "__part").orderBy("__at")) - 1)
    return ranked.join(offsets, ["split", "__part"]).withColumn("row_id", (F.col("__before") + F.col("__rank")).cast("long")).drop("__at", "__part", "__rank", "__before")


def canonical(df: DataFrame, config: AuditConfig, row_id: Column | None = None) -> DataFrame:
    """``df`` with a ``split`` column to canonical records. ``row_id`` replaces the position as read."""
    columns = df.columns
    role = {r: resolve(columns, r, config.columns.get(r)) for r in CANDIDATES}
    if role["entity"] is None:
        raise KeyError("no entity column; set info.smiles_col")
    labels = config.label_cols or ([role["label"]] if role["label"] else [])
    missing = [c for c in labels if c not in columns]
    if missing:
        raise KeyError(f"no such label columns: {', '.join(missing)}")
    if not labels:
        raise KeyError("no label column; set info.label_col")
    if config.is_dti and role["sequence"] is None:
        raise KeyError("drug-target data need a sequence column; set info.sequence_col")
    out = with_labels(df, labels)
    out = numbered(out) if row_id is None else out.withColumn("row_id", row_id.cast("long"))
    made = {"entity": F.col(role["entity"]).cast("string"), "id": F.col(role["id"]).cast("string") if role["id"] else F.col("row_id").cast("string")}
    if role["sequence"]:
        made["target_seq"] = sequence(F.col(role["sequence"]))
        made["target_id"] = F.col(role["target_id"]).cast("string") if role["target_id"] else F.lit(None).cast("string")
    rest = [F.col(c) for c in columns if c not in CANONICAL and c not in made]
    return out.select("split", "row_id", "label_num", "label_key", *[c.alias(n) for n, c in made.items()], *rest)


def with_named_splits(df: DataFrame, split_col: str) -> DataFrame:
    """``split`` by its canonical names; values that aren't one are an error that lists some."""
    if split_col not in df.columns:
        raise KeyError(f"no split column {split_col}")
    named = df.withColumn("__split", split_name(F.col(split_col)))
    bad = [r[0] for r in named.where("__split is null").select(F.col(split_col).cast("string")).distinct().limit(6).collect()]
    if bad:
        raise ValueError(f"unknown split labels: {', '.join(map(str, bad[:5]))}{' ...' if len(bad) > 5 else ''}")
    return (named.drop(split_col) if split_col == "split" else named).withColumnRenamed("__split", "split")


def split_by_method(df: DataFrame, config: AuditConfig) -> DataFrame:
    """A table without split column, split as the config says. ``row_id`` is the place in the table as read."""
    method = splitters.splitter(config.split_method)
    rows = numbered(df.withColumn("split", F.lit("all"))).withColumnRenamed("row_id", "__place").drop("split")
    if method is splitters.random_split:
        out = method(rows, config.split_fracs, config.split_seed, row_id="__place")
    elif method is splitters.exact_split:
        out = method(rows, "__place", config.split_fracs, config.split_seed)
    else:
        entity = resolve(df.columns, "entity", config.columns.get("entity"))
        if entity is None:
            raise KeyError("no entity column; set info.smiles_col")
        place = {"row_id": "__place"} if method is splitters.group_split else {}
        out = method(rows.withColumn("__scaffold", scaffold(F.col(entity))), "__scaffold", config.split_fracs, config.split_seed, **place).drop("__scaffold")
    return canonical(out, config, F.col("__place")).drop("__place")


def from_one_table(df: DataFrame, config: AuditConfig) -> DataFrame:
    if config.split_col not in df.columns and config.split_method:
        return required(split_by_method(df, config), ("train", "valid", "test"))
    return required(canonical(with_named_splits(df, config.split_col), config), ("train", "valid", "test"))


def from_tables(tables: Mapping[str, DataFrame], config: AuditConfig) -> DataFrame:
    """One table per split. They are united by name before anything else is done."""
    united = None
    for name, df in tables.items():
        tagged = df.drop("split").withColumn("split", F.lit(name))
        united = tagged if united is None else united.unionByName(tagged, allowMissingColumns=True)
    if united is None:
        raise ValueError("no tables")
    return canonical(united, config)


def required(records: DataFrame, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """``records``, if none of these splits is empty."""
    found = {r[0] for r in records.select("split").distinct().collect()}
    lacking = [s for s in splits if s not in found]
    if lacking:
        raise ValueError(f"empty splits: {', '.join(lacking)}")
    return records


def load(spark: SparkSession, config: AuditConfig) -> DataFrame:
    """Records of any source."""
    if config.source in ADAPTERS:
        return from_tables(ADAPTERS[config.source](spark, config), config)
    if config.path:
        return from_one_table(read_table(spark, config.path), config)
    return required(from_tables({s: read_table(spark, p) for s, p in (config.paths or {}).items()}, config))


TDC_COLLECTIONS = ("ADME", "Tox", "HTS", "QM")


def _tdc(spark: SparkSession, config: AuditConfig) -> dict[str, DataFrame]:
    """Therapeutics catalogue: the first collection that knows the name; needs its own package."""
    from importlib import import_module

    single = import_module("tdc.single_pred")

    def opened(collection: str):
        try:
            return getattr(single, collection)(name=config.name, path=config.data_path)
        except Exception:  # the package raises what it likes for a name that it doesn't know
            return None

    data = next((x for x in map(opened, TDC_COLLECTIONS) if x is not None), None)
    if data is None:
        raise ValueError(f"no collection of {', '.join(TDC_COLLECTIONS)} has {config.name}")
    parts = data.get_split(**({"method": config.info["split"]} if config.info.get("split") else {}))
    return {s: spark.createDataFrame(parts[s]) for s in ("train", "valid", "test")}


def _polaris(spark: SparkSession, config: AuditConfig) -> dict[str, DataFrame]:
    """Benchmark hub: train and test only; needs its own package."""
    import pandas as pd
    from importlib import import_module

    train, test = import_module("polaris").load_benchmark(config.name).get_train_test_split()
    frame = lambda part: pd.DataFrame({"smiles": list(part.inputs), **({"label": list(part.targets)} if getattr(part, "targets", None) is not None else {})})
    return {"train": spark.createDataFrame(frame(train)), "test": spark.createDataFrame(frame(test))}


#: Sources beyond files; more can be registered.
ADAPTERS = {"tdc": _tdc, "polaris": _polaris}
