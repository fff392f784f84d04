"""Language ID by fusing evidence in a Bayesian way.

Four sources of evidence about a document's language l are multiplied:

* its text: a naive Bayes model of hashed byte trigrams without digits over the whole text, tempered by ``TEMPER`` since
  neighbouring trigrams are not independent. A background class, every trigram alike, stands for text in none
  of the languages (``und``);
* the language that its markup or record declares, right with probability ``DECLARED``;
* the suffix of its address, where it names a country whose language is known, right with probability ``SUFFIX``;
* a prior of its host: votes of confident text decisions over the whole corpus, by grouped aggregation, smoothed
  hierarchically: host towards registered domain, domain towards address suffix, suffix towards corpus, corpus towards
  uniform. Each level is counted without the level below it, and a host without the document's own vote, so that no
  text speaks twice.

``decisive`` names the sources of evidence without which the decision would be another: text, declared, suffix, host.

The languages are all labels of non-empty texts, by aggregation over all rows. The model is fitted on a bounded sample of
each: at most ``SAMPLE`` different rows a label, those with the least hash of id and text, and of each the first
``SAMPLE_BYTES`` bytes. The driver gets counts of trigrams and hashes, never texts. Everything else covers all rows.
A document is rejected if ``und`` is most probable.

Defined results: a null or empty text is ``und`` whatever is declared; an unknown declaration, suffix or host, or
a null, is no evidence; ties go to the language first in order; rows with the same id and text are judged
alike; an empty table gives no rows; without any labelled row nothing can be judged: all is ``und`` and nothing is
rejected; other columns pass through ``accepted``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import chosen, column, flat, lean, place, saved
from splitlens.llm.textscan import LOWER, mix, text_buffers

BUCKETS, SAMPLE, SAMPLE_BYTES = 1 << 15, 4000, 16_384
TEMPER, DECLARED, SUFFIX, STRENGTH, SURE = 0.2, 0.95, 0.8, 20.0, 0.9
UNKNOWN = "und"
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}


def _grams(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams that lie between two ``cuts``, and where those of each such part begin and end."""
    own = LOWER[data].astype(np.uint32)
    gram = own[:-2] | own[1:-1] << np.uint32(8) | own[2:] << np.uint32(16) if len(own) > 2 else own[:0]
    inside = np.ones(len(gram), bool)
    for back in (1, 2):  # trigrams that reach over the end of a text
        at = cuts - back
        inside[at[(at >= 0) & (at < len(gram))]] = False
    digit = (own >= 0x30) & (own <= 0x39)
    inside &= ~(digit[: len(gram)] | digit[1 : len(gram) + 1] | digit[2 : len(gram) + 2])
    before = np.concatenate([[0], np.cumsum(inside)])
    return (mix(gram[inside].astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64), before[np.minimum(cuts, len(gram))]


def trigrams(texts: pa.Array, slice_bytes: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, buckets of all trigrams, and where each row's begin and end. A text over a slice's size comes in
    pieces, each for its row, so memory does not follow the longest text."""
    offsets, data = text_buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
        first, last = int(offsets[row]), int(offsets[end])
        if end == row + 1:
            for at in range(first, max(last, first + 1), slice_bytes):  # a piece has two bytes of the next
                piece = data[at : min(last, at + slice_bytes + 2)]
                yield row, *_grams(piece, np.array([0, len(piece)]))
        else:
            yield row, *_grams(data[first:last], offsets[row : end + 1] - first)
        row = end


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Log likelihoods, a row per text, a column per language and one for the background."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        for row, buckets, bounds in trigrams(texts):
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                out[row + full] += np.add.reduceat(self.weights[buckets], bounds[full], axis=0, dtype=np.float64)
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of texts by label and bucket."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        labels, texts = column(batch, "l"), column(batch, "t").cast(pa.large_string(), safe=False)  # may end within a character
        for label in labels.unique().to_pylist():
            counts = sums.setdefault(label, np.zeros(BUCKETS, np.int64))
            for _, buckets, _ in trigrams(texts.filter(pc.equal(labels, label))):
                counts += np.bincount(buckets, minlength=BUCKETS)
    for label, counts in sums.items():
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(counts[full])], names=["l", "bucket", "n"])


def fit(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    rows = chosen(docs, id=id_col, t=text_col, l=label_col).where((F.col("l") != UNKNOWN) & (F.octet_length("t") > 0))
    hashed = rows.select("l", "t", F.xxhash64("id", "t").alias("h"))
    found = hashed.groupBy("l").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).collect()  # a row for each label
    languages = sorted(r.l for r in found)
    weights = np.full((BUCKETS, len(languages) + 1), -np.log(BUCKETS), np.float32)
    if languages:
        # of each label a share of the hash range that holds half as many again, and its first row in any case
        shares = [(r.l, max(r.least, min((1 << 63) - 1, int(min(1.0, 1.5 * sample / r.n) * (1 << 64)) - (1 << 63)))) for r in found]
        below = lambda df, ends: df.join(F.broadcast(spark.createDataFrame(ends, "l string, end long")), "l").where("h <= end").drop("end")
        some = saved(below(hashed, shares).withColumn("t", F.substring(F.col("t").cast("binary"), 1, SAMPLE_BYTES)).dropDuplicates(["l", "h"]), "language-sample")
        hashes = some.select("l", "h").toArrow().sort_by([("l", "ascending"), ("h", "ascending")])
        own = {x: hashes.filter(pc.equal(hashes["l"], x))["h"] for x in languages}
        ends = [(x, own[x][min(sample, len(own[x])) - 1].as_py()) for x in languages]
        counted = below(some, ends).select("l", "t").mapInArrow(lean(_counted), "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
        for i, language in enumerate(languages):
            of = counted.filter(pc.equal(counted["l"], language))
            counts = np.full(BUCKETS, 0.05)
            counts[of["bucket"].to_numpy()] += of["n"].to_numpy()
            # a label without any trigram stays below the background
            weights[:, i] = np.log(counts / (0.05 * BUCKETS + max(1, of.num_rows and counts.sum() - 0.05 * BUCKETS)))
    return Model(languages, weights)


def html_language(html: Column) -> Column:
    """The language that an ``html`` tag declares, without its region."""
    return F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))


def html_text(html: Column) -> Column:
    """What a page shows: without comments, scripts, styles, tags and character references."""
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(shown, r"<[^>]*>", " "), r"&#?[A-Za-z0-9]+;", " ")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _sums(name: str, of: str, n: int) -> list[Column]:
    return [F.sum(f"{of}{i}").alias(f"{name}{i}") for i in range(n)]


def _host_priors(scored: DataFrame, best: Column, sure: Column, n: int) -> tuple[DataFrame, list[float]]:
    """``host``, its votes ``votes`` and the prior ``above`` that its domain, suffix and the corpus give; the corpus's own."""
    votes = scored.where(sure).groupBy("host", best.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    by_host = votes.groupBy("host").agg(*[F.sum(F.when(F.col("l") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(n)])
    by_host = saved(by_host.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)), "host-votes")
    corpus = by_host.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"c{i}") for i in range(n)]).first()
    of_corpus = [(c + 1) / (sum(corpus) + n) for c in corpus]
    known = by_host.where("host is not null")
    by_domain = known.groupBy("domain").agg(*_sums("d", "n", n))
    by_suffix = known.groupBy("suffix").agg(*_sums("t", "n", n))

    def smoothed(name: str, without: str, above: list[Column]) -> list[Column]:
        own = [F.col(f"{name}{i}") - F.col(f"{without}{i}") for i in range(n)]
        return [(own[i] + STRENGTH * above[i]) / (sum(own, F.lit(0.0)) + STRENGTH) for i in range(n)]

    every = known.join(by_domain, "domain").join(by_suffix, "suffix")
    every = every.select("host", *[f"{x}{i}" for x in "nd" for i in range(n)], *[c.alias(f"p{i}") for i, c in enumerate(smoothed("t", "d", [F.lit(x) for x in of_corpus]))])
    above = F.array(*smoothed("d", "n", [F.col(f"p{i}") for i in range(n)]))
    return saved(every.select("host", F.array(*[F.col(f"n{i}") for i in range(n)]).alias("votes"), above.alias("above")), "host-priors"), of_corpus


def judged(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", declared: Column | str | None = None, url: Column | str | None = None, host: Column | str | None = None) -> DataFrame:
    """Per row ``doc_id``, ``rk`` (fingerprint of the text), ``language``, ``posterior``, ``text_language``, ``decisive``,
    ``accepted``. ``declared``, ``url`` and ``host`` are columns or their names; the host is
    that of ``url`` where ``host`` is null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    classes = [*model.languages, UNKNOWN]
    n = len(classes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            scores = shared.value.scores(texts) * TEMPER
            scores -= scores.max(axis=1, keepdims=True)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), listed], names=[*names, "s"])

    given = {k: v for k, v in (("declared", declared), ("url", url), ("host", host)) if v is not None}
    made = [v for v in given.values() if isinstance(v, Column)]
    every, rest = flat(docs.select("*", *made)), iter(range(len(docs.columns), len(docs.columns) + len(made)))
    named = {k: F.col(f"c{next(rest)}" if isinstance(v, Column) else place(docs, v)).alias(k) for k, v in given.items()}
    rows, none = every.select(F.col(place(docs, id_col)).alias("doc_id"), F.col(place(docs, text_col)).alias("text"), *named.values()), F.lit(None).cast("string")
    of = lambda name: F.col(name) if name in given else none
    site = F.coalesce(F.lower(of("host")), _host(of("url")))
    own = rows.select(
        "doc_id",
        F.xxhash64("text").alias("rk"),
        (F.octet_length(F.coalesce("text", F.lit(""))) == 0).alias("empty"),
        F.lower(of("declared")).alias("declared"),
        F.when(site != "", site).alias("host"),
        "text",
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    scored = saved(own.mapInArrow(lean(score), f"{kinds}, s array<double>"), "language-scores")

    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x))
    best = F.array_position("s", F.array_max("s")).cast("int") - 1  # the first of equals
    sure = ~F.col("empty") & (1 / total >= SURE)
    priors, of_corpus = _host_priors(scored, best, sure, n)

    def evidence(value: Column, right: float) -> list[Column]:
        known = value.isin(model.languages) if model.languages else F.lit(False)
        wrong = (1 - right) / max(1, n - 1)
        return [F.when(F.coalesce(known, F.lit(False)), F.log(F.when(value == c, right).otherwise(wrong))).otherwise(0.0) for c in classes]

    pairs, suffix = [x for x in SUFFIXES.items() if x[1] in model.languages], F.substring_index("host", ".", -1)
    suggested = F.coalesce(*[F.when(F.contains("host", F.lit(".")) & (suffix == s), lang) for s, lang in pairs], none) if pairs else none
    votes, above = F.coalesce("votes", F.array(*[F.lit(0).cast("long")] * n)), F.coalesce("above", F.array(*[F.lit(x) for x in of_corpus]))
    voted = sure & F.col("host").isNotNull()
    cast, size = F.when(voted, best).otherwise(-1), F.aggregate(votes, F.lit(0).cast("long"), lambda a, x: a + x) - voted.cast("long")
    # a host that no row has spreads the rows without host, which would meet in one task otherwise
    none_such = F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id", "rk"), F.lit(1024)).cast("string"))
    out = scored.withColumn("at", F.coalesce("host", none_such)).join(priors.withColumnRenamed("host", "at"), "at", "left")
    terms = {
        "text": [F.get("s", F.lit(i)) for i in range(n)],
        "declared": evidence(F.col("declared"), DECLARED),
        "suffix": evidence(suggested, SUFFIX),
        "host": [F.log((F.get(votes, F.lit(i)) - (cast == i).cast("long") + STRENGTH * F.get(above, F.lit(i))) / (size + STRENGTH)) for i in range(n)],
    }
    out = out.select("doc_id", "rk", "empty", best.alias("best"), *[F.array(*x).alias(f"of_{k}") for k, x in terms.items()])

    def fused(names: list[str]) -> Column:
        return F.array(*[sum((F.get(f"of_{k}", F.lit(i)) for k in names), F.lit(0.0)) for i in range(n)])

    first = lambda f: F.array_position(f, F.array_max(f)).cast("int") - 1
    out = out.select("doc_id", "rk", "empty", "best", fused([*terms]).alias("f"), *[first(fused([x for x in terms if x != k])).alias(f"no_{k}") for k in terms])
    out = out.withColumn("top", F.array_max("f")).withColumn("place", first(F.col("f")))
    named = lambda at: F.when(F.col("empty"), F.lit(UNKNOWN)).otherwise(F.get(F.array(*[F.lit(c) for c in classes]), at))
    share = F.when(F.col("empty"), 1.0).otherwise(1 / F.aggregate("f", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    decisive = F.when(F.col("empty"), "").otherwise(F.concat_ws(",", *[F.when(F.col(f"no_{k}") != F.col("place"), k) for k in terms]))
    out = out.select("doc_id", "rk", named(F.col("place")).alias("language"), share.alias("posterior"), named(F.col("best")).alias("text_language"), decisive.alias("decisive"))
    return out.withColumn("accepted", (F.col("language") != UNKNOWN) | F.lit(not model.languages))


def accepted(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", **evidence) -> DataFrame:
    """``docs`` without rejected documents; columns as they are."""
    if not model.languages:
        return docs
    found = judged(docs, model, id_col=id_col, text_col=text_col, **evidence)
    gone = saved(found.where(~F.col("accepted")).select("doc_id", "rk").distinct(), "rejected")  # of known size: a few rows are broadcast
    rows, key = flat(docs), F.col(place(docs, id_col))
    same = key.eqNullSafe(F.col("doc_id")) & (F.xxhash64(place(docs, text_col)) == F.col("rk"))
    return rows.join(gone, same, "left_anti").toDF(*docs.columns)
