import random

import pytest
from pyspark.sql import functions as F

from splitlens.llm import language_id

KINDS = {"xx": "abcde", "yy": "vwxyz", "zz": "αβγδε", "ww": "жзийк"}


def text(r, kind, n):
    return " ".join("".join(r.choices(KINDS[kind], k=4)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """6,000 rows of one language, two labelled once, one of them on a long text only; many copies of one row."""
    r = random.Random(5)
    rows = [(i, text(r, "xx", 6), "xx", "a") for i in range(6000)]
    rows += [(7000, text(r, "zz", 40), "zz", "a"), (7001, "." + text(r, "ww", 4000), "ww", "a")] + [(7002, text(r, "yy", 40), "yy", "a")] * 300
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_every_label_is_a_language(spark, docs):
    assert docs.where("octet_length(text) > 16384").count() == 1
    for sample in (1, 20, language_id.SAMPLE):
        model = language_id.fit(docs, sample=sample)
        assert model.languages == ["ww", "xx", "yy", "zz"]
    r = random.Random(6)
    rare = spark.createDataFrame([(8000 + i, text(r, k, 20), k, "a") for i, k in enumerate(["ww", "yy", "zz"] * 5)], docs.schema)
    found = language_id.judged(docs.unionByName(rare), model, declared=F.col("lang"), host=F.col("source")).join(rare, "doc_id")
    assert [(r.language, r.text_language) for r in found.collect() if r.language != r.lang or r.text_language != r.lang] == []
    kept = language_id.accepted(docs, model, declared=F.col("lang"), host=F.col("source"))
    assert kept.where("lang <> 'xx'").count() == 302


def test_sample_of_a_label_is_bounded_and_spares_short_texts(spark, docs):
    counted = language_id.fit(docs, sample=10).weights[:, 1]
    ten = docs.where("lang = 'xx'").withColumn("h", F.xxhash64("doc_id", "text")).orderBy("h").limit(10)
    assert (counted == language_id.fit(ten).weights[:, 0]).all()
    odd = spark.createDataFrame([(1, "12", "qq", "a"), (2, "日本語のテキスト" * 9, None, "a")], docs.schema)
    model = language_id.fit(docs.unionByName(odd), sample=50)
    assert "qq" in model.languages
    found = {r.doc_id: r.language for r in language_id.judged(odd, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert found == {1: "qq", 2: "und"}


def test_trigrams_of_long_texts_come_in_pieces():
    import numpy as np
    import pyarrow as pa

    r = random.Random(3)
    texts = pa.array([text(r, "xx", 3), "", None, text(r, "zz", 500), "a", text(r, "yy", 90) + " 12 " + text(r, "yy", 90)])
    for size in (1, 7, 64, 1 << 18):
        found = np.zeros((len(texts), language_id.BUCKETS), int)
        for row, buckets, bounds in language_id.trigrams(texts, size):
            for i in range(len(bounds) - 1):
                found[row + i] += np.bincount(buckets[bounds[i] : bounds[i + 1]], minlength=language_id.BUCKETS)
        for i, t in enumerate(texts.to_pylist()):
            raw = (t or "").encode()
            grams = [raw[k : k + 3] for k in range(len(raw) - 2) if not any(0x30 <= c <= 0x39 for c in raw[k : k + 3])]
            want = language_id.mix(np.array([int.from_bytes(g, "little") for g in grams], np.uint64)) % np.uint64(language_id.BUCKETS)
            assert (np.bincount(want.astype(int), minlength=language_id.BUCKETS) == found[i]).all()


def fused_by_hand(rows, scores, languages):
    """Language, posterior and decisive sources of each row, from the scores of its text."""
    import math

    classes = [*languages, language_id.UNKNOWN]
    n, k = len(classes), language_id.STRENGTH
    first = lambda v: max(range(n), key=lambda i: (v[i], -i))
    s = [[x * language_id.TEMPER for x in row] for row in scores]
    s = [[x - max(row) for x in row] for row in s]
    site = lambda r: ((r["host"] if r["host"] is not None else language_id_host(r["url"])) or "").lower() or None
    sure = [bool(r["text"]) and 1 / sum(map(math.exp, v)) >= language_id.SURE for r, v in zip(rows, s, strict=True)]
    votes, hosts = {}, [site(r) for r in rows]
    for h, v, ok in zip(hosts, s, sure, strict=True):
        if ok:
            votes.setdefault(h, [0] * n)[first(v)] += 1
    total = [sum(v[i] for v in votes.values()) for i in range(n)]
    corpus = [(c + 1) / (sum(total) + n) for c in total]
    part = lambda h, m: ".".join(h.split(".")[-m:])
    of = lambda m, name: [sum(v[i] for h, v in votes.items() if h is not None and part(h, m) == name) for i in range(n)]
    smooth = lambda own, above: [(own[i] + k * above[i]) / (sum(own) + k) for i in range(n)]
    out = []
    for r, h, v, ok in zip(rows, hosts, s, sure, strict=True):
        own, above = [0] * n, corpus
        if h in votes and h is not None:
            suffix, domain = of(1, part(h, 1)), of(2, part(h, 2))
            above = smooth([a - b for a, b in zip(suffix, domain, strict=True)], corpus)
            above = smooth([a - b for a, b in zip(domain, votes[h], strict=True)], above)
            own = list(votes[h])
            if ok:
                own[first(v)] -= 1
        said = (r["declared"] or "").lower()
        country = language_id.SUFFIXES.get(part(h, 1)) if h and "." in h else None
        likely = lambda c, right: [math.log(right if x == c else (1 - right) / (n - 1)) if c in languages else 0.0 for x in classes]
        terms = {"text": v, "declared": likely(said, language_id.DECLARED), "suffix": likely(country, language_id.SUFFIX), "host": [math.log(x) for x in smooth(own, above)]}
        add = lambda names: [sum(terms[t][i] for t in names) for i in range(n)]  # noqa: E731,B023
        f = add(terms)
        if not r["text"]:
            out.append((language_id.UNKNOWN, 1.0, ""))
            continue
        decisive = ",".join(t for t in terms if first(add([x for x in terms if x != t])) != first(f))
        out.append((classes[first(f)], 1 / sum(math.exp(x - max(f)) for x in f), decisive))
    return out


def language_id_host(url):
    import re

    found = re.match(r"[^:/?#]*://(?:[^/?#@]*@)?([^/:?#]*)", url or "")
    return found.group(1) if found else None


def test_fusion_equals_the_sums_by_hand(spark):
    """Texts from long to none, on hosts of several levels, with declarations and suffixes that disagree; each source decides some."""
    import pyarrow as pa

    r = random.Random(9)
    kinds = {"de": "abcde", "fr": "defgh", "en": "ghijk"}
    word = lambda k, n: " ".join("".join(r.choices(kinds[k], k=4)) for _ in range(n))
    learned = spark.createDataFrame([(i, word(k, 12), k) for i, k in enumerate(list(kinds) * 40)], "doc_id long, text string, lang string")
    model = language_id.fit(learned)
    rows = []
    for i in range(400):
        kind = r.choice(list(kinds))
        host = r.choice([f"{r.choice(['a', 'b'])}.{kind}wiki.org", f"www.shop.{r.choice(['de', 'fr', 'at', 'uk'])}", "alone", None, "x.co.uk", "", f"once{i}.net"])
        url = r.choice([None, f"https://u@Site{i % 3}.fr:80/a?b", "no address"])
        rows.append({"doc_id": i, "text": r.choice([None, "", "..", word(kind, 1)[:4], word(kind, 1), word(kind, 2), word(kind, 30)]), "declared": r.choice([None, None, kind, "DE", "fr", "zz"]), "url": url, "host": host})
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, url string, host string")
    got = {x.doc_id: x for x in language_id.judged(df, model, declared="declared", url="url", host="host").collect()}
    scores = model.scores(pa.array([x["text"] for x in rows], pa.string())).tolist()
    decided = set()
    for row, want in zip(rows, fused_by_hand(rows, scores, model.languages), strict=True):
        x = got[row["doc_id"]]
        assert (x.language, x.decisive) == (want[0], want[2]), (row, want, x)
        assert x.posterior == pytest.approx(want[1])
        decided |= set(want[2].split(","))
    assert {"text", "declared", "suffix", "host"} <= decided
