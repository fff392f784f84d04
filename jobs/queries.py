"""The jobs as queries: each runs twice into one new folder, and what stands there then is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import clean_splits, pair_ledger
from splitlens.session import shared_folder


def job1_clean_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    tables = f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"
    for _ in range(2):
        clean_splits.run(spark, *tables, out)
    found = clean_splits.cleaned(spark, *tables, out)
    label = lambda i: F.get("label_num", F.lit(i)).cast("long")
    return found.select(F.col("row_id").alias("doc_id"), "split", "verdict", F.array_join("reasons", ",").alias("reasons"), F.col("n_warnings").cast("long").alias("n_warnings"), label(0).alias("quality"), label(1).alias("toxic"), F.sha2("entity", 256).alias("text_sha256"))


def job2_pair_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        pair_ledger.run(spark, f"{sf_dir}/lineitem.parquet", out, f"{out}/checkpoint")
    found = pair_ledger.read_ledger(spark, out)
    return found.select("entity", "target_seq", "n_rows", "n_labels", "mask", "first_row", "cross_split", F.array_join("kinds", ",").alias("kinds"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_clean_splits": job1_clean_splits, "job2_pair_ledger": job2_pair_ledger}


def _split(key: str, train: int, valid: int) -> str:
    return f"CASE WHEN {key} % 10 < {train} THEN 'train' WHEN {key} % 10 < {train + valid} THEN 'valid' ELSE 'test' END"


def oracle_sql() -> dict[str, str]:
    rules = " + ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) > {most} AS BIGINT)" for p, most in [("[0-9]{9,}", 0), ("[a-z0-9.]+@[a-z0-9.]+", 0), (",", 40)])
    differ = lambda a, b: f"({a}.quality IS DISTINCT FROM {b}.quality OR {a}.toxic IS DISTINCT FROM {b}.toxic)"
    pair = [("intra_train", "'train'", "'train'"), ("intra_valid", "'valid'", "'valid'"), ("intra_test", "'test'", "'test'"), ("cross_train_valid", "'train'", "'valid'"), ("cross_train_test", "'train'", "'test'"), ("cross_valid_test", "'valid'", "'test'"), ("severe_trainvalid_test", "'train', 'valid'", "'test'")]
    found = " UNION ".join(f"SELECT a.entity, a.target_seq, '{k}' AS kind FROM items AS a JOIN items AS b ON a.entity = b.entity AND a.target_seq = b.target_seq WHERE a.split IN ({x}) AND b.split IN ({y}) AND a.label <> b.label" for k, x, y in pair)
    return {
        "job1_clean_splits": f"""
            WITH marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
            recs AS (SELECT d.doc_id, d.text, m.quality, m.toxic, {_split('d.doc_id', 7, 1)} AS split, {rules} AS n_warnings FROM documents AS d LEFT JOIN marks AS m ON m.doc_id = d.doc_id),
            seen AS (SELECT DISTINCT text, split, quality, toxic FROM recs),
            wrong AS (
                SELECT DISTINCT a.text, a.split FROM seen AS a JOIN seen AS b ON a.text IS NOT DISTINCT FROM b.text
                WHERE (a.split = b.split AND a.text IS NOT NULL AND {differ('a', 'b')})
                   OR (a.split <> b.split AND EXISTS (SELECT 1 FROM seen AS c WHERE c.text IS NOT DISTINCT FROM a.text AND c.split IN (a.split, b.split) AND {differ('a', 'c')}))
            ),
            flags AS (
                SELECT r.*, r.doc_id > min(r.doc_id) OVER (PARTITION BY r.split, r.text) AS f1,
                       r.split <> 'test' AND r.text IN (SELECT text FROM recs WHERE split = 'test' AND text IS NOT NULL) AS f2, w.split IS NOT NULL AS f3, r.n_warnings > 0 AS f4
                FROM recs AS r LEFT JOIN wrong AS w ON w.text IS NOT DISTINCT FROM r.text AND w.split = r.split
            ),
            named AS (SELECT *, list_filter([CASE WHEN f1 THEN 'duplicate' END, CASE WHEN f2 THEN 'contaminated' END, CASE WHEN f3 THEN 'conflict' END, CASE WHEN f4 THEN 'alert' END], lambda x: x IS NOT NULL) AS reasons FROM flags)
            SELECT doc_id, split, coalesce(reasons[1], 'kept') AS verdict, array_to_string(reasons, ',') AS reasons, n_warnings, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, sha256(text) AS text_sha256
            FROM named""",
        "job2_pair_ledger": f"""
            WITH items AS (
                SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_partkey AS VARCHAR) AS entity, CAST(l_suppkey AS VARCHAR) AS target_seq, l_returnflag AS label, {_split('l_orderkey', 8, 1)} AS split FROM lineitem
            ), found AS ({found}), named AS (SELECT entity, target_seq, string_agg(kind, ',' ORDER BY kind) AS kinds FROM found GROUP BY entity, target_seq),
            pairs AS (
                SELECT entity, target_seq, count(*) AS n_rows, count(DISTINCT label) AS n_labels, min(row_id) AS first_row, count(DISTINCT split) > 1 AS cross_split,
                       CAST(max(CASE split WHEN 'train' THEN 1 ELSE 0 END) + max(CASE split WHEN 'valid' THEN 2 ELSE 0 END) + max(CASE split WHEN 'test' THEN 4 ELSE 0 END) AS INTEGER) AS mask
                FROM items GROUP BY entity, target_seq
            )
            SELECT p.entity, p.target_seq, p.n_rows, p.n_labels, p.mask, p.first_row, p.cross_split, coalesce(n.kinds, '') AS kinds
            FROM pairs AS p LEFT JOIN named AS n ON n.entity = p.entity AND n.target_seq = p.target_seq WHERE p.cross_split OR n.kinds IS NOT NULL""",
    }
