"""The operators as queries over the driver's tables. Each has a role mapping and runs over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlens.config import AuditConfig
from splitlens.functions import labels
from splitlens.operators import alerts, alignment, baselines, cliffs, conflicts, hygiene, metrics, neighbors, similarity, splitters, standardize, structures, targets
from splitlens.session import shared_folder
from splitlens.sources.records import canonical
from splitlens.streaming import incremental

BITS, THRESHOLD = 64, 0.5

#: Alert rules over text: name, pattern, largest number of matches allowed.
RULES = alerts.RuleSet(
    [
        alerts.Rule("text", "long number", "[0-9]{9,}", 0, 3),
        alerts.Rule("text", "mail address", "[a-z0-9.]+@[a-z0-9.]+", 0, 5),
        alerts.Rule("text", "license", "(?i)licensed under", 0, 1),
        alerts.Rule("text", "many commas", ",", 40, 1),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: Column, train: int = 8, valid: int = 1) -> Column:
    part = F.pmod(key, F.lit(10))
    return F.when(part < train, "train").when(part < train + valid, "valid").otherwise("test")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity is the text; labels are quality and toxicity, null where not given."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("split", split_of(F.col("doc_id"), 7, 1))
    return canonical(docs, AuditConfig("classification", columns={"entity": "text", "id": "doc_id"}, label_cols=["quality", "toxic"]), F.col("doc_id"))


def orders(spark: SparkSession, sf_dir: str, label: str, task: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", label).withColumn("split", split_of(F.col("o_orderkey")))
    return canonical(own, AuditConfig(task, columns={"entity": "o_custkey", "id": "o_orderkey", "label": label}), F.col("o_orderkey"))


def order_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_orderpriority", "classification")


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir, "o_totalprice", "regression")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity is the part, target the supplier."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").cast("string").alias("sequence"), "l_returnflag").withColumn("split", split_of(F.col("l_orderkey")))
    config = AuditConfig("classification", "dti", columns={"entity": "l_partkey", "label": "l_returnflag"})
    return canonical(own, config, F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def sign_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sets: the numbers of their positive components."""
    v = table(spark, sf_dir, "embeddings")
    bits = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    return v.select(F.col("vec_id").alias("id"), bits.alias("bits"), "label", split_of(F.col("vec_id")).alias("split"))


def vector_records(spark: SparkSession, sf_dir: str, task: str = "classification") -> DataFrame:
    v = sign_bits(spark, sf_dir).withColumn("entity", F.col("id").cast("string"))
    return canonical(v.withColumnRenamed("bits", "fp"), AuditConfig(task, columns={"entity": "entity", "label": "label", "id": "id"}), F.col("id"))


def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.split_counts(documents(spark, sf_dir))


def q_duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.overlap(documents(spark, sf_dir), "entity").select("n_rows", "n_unique", "n_duplicates")


def q_contamination_tv_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.overlap(documents(spark, sf_dir), "entity").select(F.col("shared_tv_test").alias("n_contaminated"))


def q_entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.overlap(order_classes(spark, sf_dir), "entity")


def q_target_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.overlap(lineitems(spark, sf_dir), "target_seq")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def q_label_stats_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hygiene.label_stats(order_prices(spark, sf_dir)), "mean", "std")


def q_label_stats_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hygiene.label_stats(documents(spark, sf_dir)), "mean", "std")


def q_three_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma3 = hygiene.three_sigma(order_prices(spark, sf_dir))
    return spark.createDataFrame([(i, round(x, 4)) for i, x in enumerate(sigma3)], "pos int, sigma3 double")


def q_warning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hygiene.warning_stats(alerts.screen(documents(spark, sf_dir), "entity", RULES)), "mean", "std")


def q_conflict_counts_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.conflict_counts(conflicts.classification_conflicts(order_classes(spark, sf_dir)))


def q_conflict_counts_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_prices(spark, sf_dir)
    return conflicts.conflict_counts(conflicts.regression_conflicts(records, hygiene.three_sigma(records)))


def q_conflict_counts_multitask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.conflict_counts(conflicts.classification_conflicts(documents(spark, sf_dir)))


def q_conflict_rows_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_classes(spark, sf_dir)
    return conflicts.conflict_rows(records, conflicts.classification_conflicts(records)).select("kind", "split", "row_id", "entity", F.col("label_key")[0].alias("label"))


def q_conflict_rows_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_prices(spark, sf_dir)
    found = conflicts.regression_conflicts(records, hygiene.three_sigma(records))
    return conflicts.conflict_rows(records, found).select("kind", "split", "row_id", "entity")


def q_conflict_pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts on (entity, target) instead of the entity alone."""
    return conflicts.conflict_counts(conflicts.classification_conflicts(lineitems(spark, sf_dir), ["entity", "target_seq"]))


def q_pair_cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.cross_split_pairs(lineitems(spark, sf_dir))


def q_target_multi_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.multi_entity_targets(lineitems(spark, sf_dir)).select("target_seq", "n_entities", "mask")


def q_target_multi_entity_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.top_multi_entity_targets(lineitems(spark, sf_dir))


def q_sequence_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_partkey").alias("order"), F.col("p_brand").alias("dataset"), split_of(F.col("p_partkey")).alias("split"), F.col("p_type").alias("file"), F.col("p_name").alias("sequence"))
    found = targets.build_registry(own)
    return found.select("sequence_id", "sequence", F.size("sources").cast("long").alias("n_sources"), F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["dataset"], s["split"], s["file"])), ";").alias("sources"))


def q_sequence_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", labels.sequence(F.concat(F.lit(" "), "p_name", F.lit("\t\n"), F.lower("p_type"))).alias("seq"))


def q_alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_counts(alerts.screen(documents(spark, sf_dir), "entity", RULES))


def q_alert_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    screened = alerts.screen(documents(spark, sf_dir), "entity", RULES.at_least(2))
    return screened.select("row_id", F.col("n_warnings").cast("long").alias("n_warnings"), "first_warning")


def q_alert_counts_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each benchmark item: its first two words."""
    words = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 2), " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("words")).where("words != ''")
    escaped = F.regexp_replace("words", r"([^\p{L}\p{N} ])", r"\\$1")
    rules = alerts.rules_from(items.orderBy("item_id").select(F.lit("items").alias("rule_set_name"), F.col("item_id").cast("string").alias("description"), escaped.alias("smarts"), F.lit(0).alias("max"), F.lit(0).alias("priority")))
    return alerts.alert_counts(alerts.screen(documents(spark, sf_dir), "entity", rules))


def q_contamination_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that a stream of the documents finds in train or valid and in test."""
    stream = incremental.files(spark, f"{sf_dir}/documents.parquet").select(F.col("text").alias("entity"), split_of(F.col("doc_id"), 7, 1).alias("split"))
    out = f"{shared_folder(spark)}/contamination-{uuid.uuid4().hex}"
    found = incremental.newly_contaminated(stream).writeStream.trigger(availableNow=True).outputMode("append").format("parquet")
    found.option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/found").start().awaitTermination()
    return spark.read.schema("key string, mask int").parquet(f"{out}/found")


def q_duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.flag_duplicates(documents(spark, sf_dir)).select("row_id", "split", "valid", "comment")


SPELLINGS = [" Train", "VAL", "valid ", "TEST", "train", "dev", "Validation"]
TOKENS = [" 1 ", "1.0", "NA", "x", "1d", "1_000", "nan", "", "-2.5e1", "Null"]


def _token(key: Column, tokens: list[str]) -> Column:
    return F.get(F.array(*[F.lit(t) for t in tokens]), F.pmod(key, F.lit(len(tokens))).cast("int"))


def q_split_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select("c_custkey", _token(F.col("c_custkey"), SPELLINGS).alias("raw"))
    return raw.select("c_custkey", labels.split_name(F.col("raw")).alias("split"))


def q_label_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select("c_custkey", _token(F.col("c_custkey"), TOKENS).alias("raw"))
    number, key = labels.coerced(F.col("raw"))
    return raw.select("c_custkey", number.alias("number"), F.when(number.isNull(), key).alias("text"))


def q_label_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of a table as labels: numbers, numbers with blanks around, words, and words that begin with a number."""
    columns = {"price": F.col("o_totalprice").cast("string"), "customer": F.concat(F.lit("  "), "o_custkey", F.lit("\t")), "priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}
    each = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("raw")) for k, v in columns.items()])).alias("s")).select("o_orderkey", "s.*")
    number, key = labels.coerced(F.col("raw"))
    return each.select("o_orderkey", "kind", number.alias("number"), F.when(number.isNull(), key).alias("text"))


def q_label_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested labels as one list."""
    nested = F.array(F.array("l_quantity"), F.array("l_discount", "l_tax"))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", nested.alias("label"), F.lit("train").alias("split"))
    records = canonical(own, AuditConfig("regression", columns={"entity": "l_partkey", "label": "label"}), F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return records.select("row_id", F.size("label_num").alias("n"), *[F.get("label_num", F.lit(i)).alias(f"label{i}") for i in range(3)])


def q_default_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without an id column are numbered within their split, as read."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", split_of(F.col("o_orderkey")).alias("split"))
    records = canonical(own, AuditConfig("classification", columns={"entity": "o_custkey", "label": "o_orderstatus"}))
    return records.select("o_orderkey", "split", "row_id", "id")


def q_weight_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hygiene.population_stats(table(spark, sf_dir, "part"), "p_retailprice"), "mean", "std")


def q_task_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which task labels ask for that no config names."""
    found = [("quality", "labels", "doc_id"), ("toxic", "labels", "doc_id"), ("label", "embeddings", "vec_id"), ("o_totalprice", "orders", "o_orderkey")]
    records = lambda c, t, k: canonical(table(spark, sf_dir, t).select(k, c, F.lit("train").alias("split")), AuditConfig("classification", columns={"entity": k, "label": c}), F.col(k))
    return spark.createDataFrame([(c, baselines.infer_task(records(c, t, k))) for c, t, k in found], "label string, task string")


def q_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", labels.slug(F.concat(F.lit(" *"), "p_type", F.lit(" / "), "p_brand", F.lit("?!"))).alias("slug"))


def q_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group_key"), F.col("p_partkey").alias("row_id"))
    return splitters.group_sizes(own, "group_key")


def q_tanimoto_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.tanimoto_pairs(sign_bits(spark, sf_dir), THRESHOLD), "similarity")


def q_nn_tanimoto(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sign_bits(spark, sf_dir)
    found = neighbors.nearest(v.where("split = 'test'").select("id", "bits"), v.where("split in ('train', 'valid')"), BITS)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


def q_nn_tanimoto_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sign_bits(spark, sf_dir)
    return _rounded(neighbors.nearest_summary(v.where("split = 'test'"), v.where("split = 'train'"), BITS), "mean", "std")


def _cliff_columns(rows: DataFrame) -> DataFrame:
    return rows.select("kind", F.col("row_id_A").alias("id_a"), F.col("row_id_B").alias("id_b"), F.round("tanimoto", 6).alias("tanimoto"), F.col("delta")[0].alias("delta"))


def q_cliff_pairs_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = vector_records(spark, sf_dir)
    return _cliff_columns(cliffs.cliff_rows(records, THRESHOLD, "classification", measures=("fp", "frame"), columns=("row_id",)))


def q_cliff_pairs_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of a label difference is given, 3."""
    records = vector_records(spark, sf_dir, "regression")
    return _cliff_columns(cliffs.cliff_rows(records, THRESHOLD, "regression", [3.0], ("fp", "frame"), ("row_id",)))


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as sequences, line items as hits between them."""
    suppliers = table(spark, sf_dir, "supplier")
    ids = suppliers.select(F.concat(F.lit("s"), "s_suppkey").alias("sequence_id"), F.col("s_name").alias("sequence"), F.array(split_of(F.col("s_suppkey"), 5, 2)).alias("splits"))
    items = table(spark, sf_dir, "lineitem")
    hits = items.select(
        F.concat(F.lit("s"), "l_suppkey").alias("query"), F.concat(F.lit("s"), F.pmod("l_partkey", F.lit(50)) + 1).alias("target"),
        F.col("l_quantity").alias("score"), F.col("l_discount").alias("probability"), F.col("l_tax").alias("evalue"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
    )
    return hits, ids


def q_best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.best_hits(*_hits(spark, sf_dir)).select("no", "split_query", "split_reference", "query", "target", "probability", "score", "line")


def q_structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = structures.best_hits(*_hits(spark, sf_dir))
    return _rounded(structures.summary(best), *[f"{c}_{s}" for c in ("probability", "score", "evalue") for s in ("mean", "std")])


def q_structure_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.top_hits(structures.best_hits(*_hits(spark, sf_dir))).select("no", "query", "target", "probability", "score")


def q_structure_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.coverage(_hits(spark, sf_dir)[1])


def q_best_alignment_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(F.col("l_suppkey").alias("query"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("reference"), (99.91 + F.col("l_discount")).alias("identity_pct"), F.col("l_quantity").alias("score"))
    return alignment.best_alignments(rows).select("query", "reference", F.round("identity_pct", 6).alias("identity_pct"), "score")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * F.col("l_quantity")).alias("score"))


def q_metric_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_predictions(spark, sf_dir)), "roc_auc")


def q_metric_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(_predictions(spark, sf_dir)), "average_precision")


def q_metric_mse_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("score"))
    return _rounded(metrics.regression_metrics(pairs), "mse", "pearson")


def q_noise_fraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("fraction"), F.col("l_quantity").alias("r"), F.col("l_tax").alias("rmse"))
    return _rounded(hygiene.fraction_summary(points, "fraction", ["r", "rmse"]), "r_mean", "r_std", "rmse_mean", "rmse_std")


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("text")).distinct()


def q_string_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.string_ratio_pairs(_part_names(spark, sf_dir), 0.7)


def q_consensus_cliffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as entities, their letters as bits, prices as labels."""
    part = table(spark, sf_dir, "part").withColumn("split", split_of(F.col("p_partkey"))).withColumn("fp", F.array_distinct(F.transform(F.split("p_name", ""), lambda c: F.ascii(c))))
    own = part.select("p_partkey", "p_name", F.col("p_brand").alias("label"), "split", "fp")
    records = canonical(own, AuditConfig("classification", columns={"entity": "p_name", "id": "p_partkey", "label": "label"}), F.col("p_partkey"))
    return cliffs.cliff_counts(records, 0.8, "classification")


def q_nn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as sequences, names' splits as theirs."""
    part = table(spark, sf_dir, "part")
    seqs = part.select(labels.sequence(F.col("p_name")).alias("seq"), split_of(F.xxhash64("p_name")).alias("split")).distinct()
    return alignment.nearest_sequences(seqs.where("split = 'test'"), seqs.where("split = 'train'"))


def q_nn_alignment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test texts of the benchmark as sequences, each against all others of train and valid."""
    items = table(spark, sf_dir, "benchmark").select(labels.sequence(F.col("text")).alias("seq"), split_of(F.col("item_id"), 7, 1).alias("split"))
    found = alignment.nearest_sequences(items.where("split = 'test'"), items.where("split <> 'test'"))
    return _rounded(found, "identity_pct", "similarity_pct", "gaps_pct")


def q_nn_alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations over the alignments of part names."""
    return _rounded(alignment.alignment_summary(q_nn_alignment(spark, sf_dir)), *[f"{c}_{s}" for c in ("identity_pct", "score", "similarity_pct") for s in ("mean", "std")])


def q_alignment_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of suppliers' line items, by return flag as comparisons."""
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(F.col("l_suppkey").alias("query"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("reference"), (90 + 100 * F.col("l_discount")).alias("identity_pct"), F.col("l_quantity").alias("score"), F.col("l_returnflag").alias("comparison"))
    best = None
    for flag in ("A", "N", "R"):
        one = alignment.best_alignments(rows.where(F.col("comparison") == flag))
        best = one if best is None else best.unionByName(one)
    return alignment.top_alignments(best).select("comparison", "query", "reference", F.round("identity_pct", 6).alias("identity_pct"), "score")


def q_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("row_id"))
    return splitters.random_split(own).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


def q_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_partkey").alias("row_id"))
    return splitters.group_split(own, "p_brand").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("groups"))


def q_exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_orderkey")
    return splitters.exact_split(own, "o_orderkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def q_hashed_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: the side of each customer."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return splitters.hashed_group_split(own, "o_custkey").groupBy("o_custkey", "split").agg(F.count(F.lit(1)).alias("n"))


def q_hashed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return splitters.hashed_split(own, "o_custkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _vector_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Vectors' components as columns, their labels as numbers."""
    v = table(spark, sf_dir, "embeddings").withColumn("split", split_of(F.col("vec_id")))
    names = [f"x{i}" for i in range(v.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    own = v.select("vec_id", "label", "split", *[F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(names)])
    return canonical(own, AuditConfig("regression", columns={"entity": "vec_id", "label": "label", "id": "vec_id"}), F.col("vec_id")), names


def q_baseline_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's forest on all components of vectors, their labels as numbers."""
    records, names = _vector_records(spark, sf_dir)
    done = baselines.run_baselines(records, "regression", columns=names, models=("random_forest",))
    m = done["models"]["random_forest"]["metrics"]
    return spark.createDataFrame([(m["mse"], m["pearson"])], "mse double, pearson double")


def q_baseline_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's network on the same, in 40 steps."""
    records, names = _vector_records(spark, sf_dir)
    done = baselines.run_baselines(records, "regression", columns=names, models=("mlp",), iterations=40)
    m = done["models"]["mlp"]["metrics"]
    return spark.createDataFrame([(m["mse"], m["pearson"])], "mse double, pearson double")


def q_baseline_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's boosted trees on the same, in 10 rounds."""
    records, names = _vector_records(spark, sf_dir)
    done = baselines.run_baselines(records, "regression", columns=names, models=("gradient_boosting",), rounds=10)
    m = done["models"]["gradient_boosting"]["metrics"]
    return spark.createDataFrame([(m["mse"], m["pearson"])], "mse double, pearson double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}
