"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlens.llm import bloom_cascade, debruijn, decontamination, impact_topk, language_id, license_scan, line_dedup, line_quality, packing, partenum, prefix_trie, token_store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The public byte-level vocabulary that the fixed results name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), vocabulary(), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "padding", "step_group")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_components(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return token_store.digests(store)


#: Fixed values of the result: verdict, host, path.
URL_RULES = [
    bloom_cascade.Rule("allow", "org", "/"),
    bloom_cascade.Rule("block", "example.org", "/es/"),
    bloom_cascade.Rule("block", "example.org", "/en/1"),
    bloom_cascade.Rule("allow", "com", "/fr/"),
    bloom_cascade.Rule("block", "com", "/de/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list stands in for an external block list: the hosts whose md5 begins with 0 to 3, and below every host a
    subdomain ``ads``, most of which no page has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(bloom_cascade.url_host(F.col("url")).alias("key")).distinct()
    listed = hosts.where(F.md5(F.col("key").cast("binary")) < "4").unionByName(hosts.select(F.concat(F.lit("ads."), "key").alias("key")))
    judged = bloom_cascade.filter_urls(pages, URL_RULES, listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.hit_spans(docs, table(spark, sf_dir, "benchmark"))
    items = F.col(decontamination.ITEMS)
    return found.select(
        "doc_id",
        F.col(decontamination.WORDS).alias("n_words"),
        F.col(decontamination.HITS).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col(decontamination.HITS) > 0).alias("contaminated"),
    )


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return impact_topk.top_k(impact_topk.build(vectors), vectors.where(F.col("vec_id") % 50 == 0), 5)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages in one judgement. The model is fitted on the documents' labels, which are no evidence
    here. Pages bring declared markup language, address suffix and hosts; documents have their source for a host."""
    docs, none = table(spark, sf_dir, "documents"), F.lit(None)
    pages = table(spark, sf_dir, "pages").select(
        none.cast("long").alias("doc_id"), "page_id", language_id.html_text(F.col("html")).alias("text"), language_id.html_language(F.col("html")).alias("declared"), "url", none.cast("string").alias("host")
    )
    every = docs.select("doc_id", none.cast("long").alias("page_id"), "text", none.cast("string").alias("declared"), none.cast("string").alias("url"), F.col("source").alias("host")).unionByName(pages)
    found = language_id.judged(every.withColumn("key", F.struct("doc_id", "page_id")), language_id.fit(docs), id_col="key", declared="declared", url="url", host="host")
    return found.select("doc_id.doc_id", "doc_id.page_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "decisive", "accepted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = debruijn.dedup_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.forked(prefix_trie.sequences(table(spark, sf_dir, "conversations")), 20, 4))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labelled documents that aren't held out; every document is scored by its text alone."""
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = line_quality.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = line_quality.scored(docs.select("doc_id", "text"), model)
    score = F.col(line_quality.SCORE)
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.col(line_quality.LINES).alias("n_lines"), F.col(line_quality.BAD).alias("n_bad_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
