"""The corpus operators on small and awkward tables, against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from splitlens.llm import bloom_cascade, debruijn, decontamination, impact_topk, language_id, license_scan, line_dedup, packing, queries, token_store
from tests.llm.data import WORDS, awkward, near_copies, sentence

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# packing


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(spark, tokenizer):
    docs = awkward(spark, near_copies(1)).repartition(3)
    got = packing.packed(docs, queries.vocabulary()).collect()
    want = sorted((ids_of(tokenizer, t, 0).tobytes() for _, t in rows_of(docs)))
    by_sequence, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    whole = sum(len(r.ids) for r in got)
    assert whole == sum(map(len, want))
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
        assert {(r.tier, r.padding, r.step_group) for r in s} == {(s[0].tier, s[0].padding, s[0].step_group)}
        assert sum(r.length for r in s) + s[0].padding == s[0].tier in packing.TIERS
    alone = {i for (i, _) in pieces if sum(1 for j, _ in rows_of(docs) if j == i) == 1}
    texts = dict(rows_of(docs))
    for (i, n), own in pieces.items():
        if i in alone:
            own.sort(key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in own) == ids_of(tokenizer, texts[i], 0).tobytes()
    assert packing.packed(docs.limit(0), queries.vocabulary()).collect() == []


def test_pack_pads_the_last_sequences_only_and_balances_groups():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 3000, 500).tolist()
    sequences = packing.pack(lengths)
    seen = defaultdict(list)
    for s in sequences:
        for doc, start, n in s:
            seen[doc].append((start, n))
    for doc, n in enumerate(lengths):
        own = sorted(seen[doc])
        assert [a for a, _ in own] == np.cumsum([0, *(k for _, k in own)])[:-1].tolist() and sum(k for _, k in own) == n
    short = [s for s in sequences if sum(n for _, _, n in s) not in packing.TIERS]
    assert len(short) <= 1
    costs = r.integers(1, 1000, 64).tolist()
    groups = packing.balanced(costs, 8)
    totals = np.bincount(groups, weights=costs)
    assert set(np.bincount(groups)) == {8} and totals.max() < 1.2 * totals.min()
    with pytest.raises(ValueError):
        packing.packed(None, "", tiers=(100, 200))


# token store


def test_store_keeps_chunks_once_and_rebuilds_texts(spark, tokenizer):
    docs = awkward(spark, near_copies(2)).repartition(3)
    store = token_store.write(docs, queries.vocabulary())
    found = sorted(token_store.digests(store).collect(), key=lambda r: r.start)
    rows = [(i, ids_of(tokenizer, t, 2)) for i, t in rows_of(docs)]
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((key(i), len(x), zlib.crc32(x.tobytes())) for i, x in rows)
    rebuilt = token_store.read_documents(store).collect()
    assert sorted((key(r.doc_id), bytes(r.ids)) for r in rebuilt) == sorted((key(i), x.tobytes()) for i, x in rows)
    chunks = store.chunks().collect()
    assert len({bytes(c.key) for c in chunks}) == len(chunks)
    assert sum(len(r.chunks) for r in store.recipes().collect()) > len(chunks)
    assert sum(r.n_docs for r in store.parts()) == len(rows)
    assert token_store.digests(token_store.write(docs.limit(0), queries.vocabulary())).collect() == []


def test_crc_of_parts_adds_up():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 50257, n).astype("<u4") for n in (1, 700, 3, 64)]
    after = np.cumsum([len(p) for p in parts][::-1])[::-1] - [len(p) for p in parts]
    shifted = token_store.shifted_crc(np.array([zlib.crc32(p.tobytes()) for p in parts]), after)
    assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(np.concatenate(parts).tobytes())


def test_damaged_chunks_are_noticed(spark):
    good = token_store.payload(np.arange(5, dtype=np.uint32))
    batch = pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(good).digest()]), pa.array([good[:-1] + b"\x09"])], names=["key", "payload"])
    with pytest.raises(ValueError):
        list(token_store._checked(iter([batch])))
    assert token_store.ids_of(token_store.payload(np.array([70000], np.uint32))).tolist() == [70000]
    ids = np.random.default_rng(2).integers(0, 50000, 20_000).astype(np.uint32)
    sizes = np.diff([0, *token_store.cut_points(ids)])
    assert sizes.sum() == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST


@pytest.mark.parametrize("folder", ["chunks/kind=chunk", "recipes/kind=doc", "recipes/kind=part", "manifest"])
@pytest.mark.parametrize("damage", ["lost", "other"])
def test_damaged_files_are_errors(spark, tmp_path, folder, damage):
    rows = [(i, sentence(__import__("random").Random(i), 300)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = token_store.write(docs, queries.vocabulary(), path=str(tmp_path / "store"))
    assert token_store.digests(store).count() == token_store.read_documents(store).count() == 40
    file = next(p for p in sorted((tmp_path / "store" / folder).glob("part-*")) if pq.read_metadata(p).num_rows)
    if damage == "lost":
        file.unlink()
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    else:
        table = pq.read_table(file, partitioning=None)
        at = next(i for i, c in enumerate(table.column_names) if c in ("payload", "crc32", "root") and table[c].null_count < len(table))
        first, rest = table[at][0].as_py(), table[at].to_pylist()[1:]
        first = first + 1 if isinstance(first, int) else first[:-1] + bytes([first[-1] ^ 1])
        pq.write_table(table.set_column(at, table.schema.field(at), pa.array([first, *rest], table.schema.field(at).type)), file)
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    for read in (token_store.digests, token_store.read_documents):
        with pytest.raises(Exception, match="agree|recipe|chunk|address|Unable|infer|manifest"):
            read(store).collect()


# Bloom cascade


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_cascade_is_exact_over_its_universe(spark, shard_bytes):
    keys = [f"host{i}.example" for i in range(3000)] + [""]
    universe = spark.createDataFrame([(k,) for k in [*keys, *keys[:50], None]], "key string")
    listed = universe.where(F.pmod(F.crc32("key"), F.lit(7)) == 0)
    cascade = bloom_cascade.build(universe, listed, shard_bytes=shard_bytes)
    assert (len(cascade.shards) > 1) == (shard_bytes == 300)
    wrong = universe.where(cascade.contains(F.col("key")) != (F.pmod(F.crc32(F.coalesce("key", F.lit(""))), F.lit(7)) == 0))
    assert wrong.count() == 0
    nothing = bloom_cascade.build(universe, universe.limit(0))
    assert universe.where(nothing.contains(F.col("key"))).count() == 0


def test_urls_hosts_paths_and_rules(spark):
    urls = ["HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://notexample.org/es/", "x://com/de/", "http://a.com?fr/", "no url", None, "a://", "http://x.com/fr/a", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = bloom_cascade.filter_urls(pages, queries.URL_RULES, spark.createDataFrame([("a.com",)], "key string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/es/", "org/", "allow"),
        ("com", "/de/", "com/de/", "block"), ("a.com", "", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("x.com", "/fr/a", "com/fr/", "allow"), ("b:", "//c/d", None, "allow"),
    ]


def test_urls_of_many_shards_and_clashing_columns(spark):
    urls = [f"http://host{i % 400}.example/{i}" for i in range(2000)]
    pages = spark.createDataFrame([(i, u, "old", 1, "x") for i, u in enumerate(urls)], "page_id int, url string, Verdict string, c0 int, listed string")
    listed = spark.createDataFrame([(f"host{i}.example",) for i in range(0, 4000, 3)], "key string")
    whole, cut = (bloom_cascade.filter_urls(pages, queries.URL_RULES, listed, shard_bytes=n) for n in (1 << 20, 500))
    assert whole.columns == cut.columns == ["page_id", "url", "c0", "listed", "host", "path", "rule", "verdict"]
    rows = [sorted(map(tuple, df.collect())) for df in (whole, cut)]
    assert rows[0] == rows[1] and {(r[4], r[7]) for r in rows[0]} == {(f"host{i}.example", "allow" if i % 3 else "block") for i in range(400)}
    assert bloom_cascade.filter_urls(pages.limit(0), queries.URL_RULES, listed).count() == 0


# decontamination


@pytest.mark.parametrize("block_bytes", [1 << 20, 200, 40])  # one block, a few, joins
def test_hits_equal_brute_force(spark, block_bytes):
    import random

    r = random.Random(6)
    items = [(1, sentence(r, 14)), (2, "Short, item HERE"), (3, sentence(r, 10)), (3, sentence(r, 25)), (4, None), (5, " ... "), (None, "nameless item text of four"), (10, "short item here")]
    rows = [(i, sentence(r, 5) + " " + r.choice([t for _, t in items if t]).upper() + "! " + sentence(r, 3)) for i in range(40)]
    docs = awkward(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(i)
    want = []
    for i, t in rows_of(docs):
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for g, own in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= own
        want.append((str(i), len(w), len(hit), sorted(x for x in found if x is not None)))
    got = decontamination.hit_spans(docs, bench, block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), r["__hit_words"], r["__n_hits"], r["__hit_items"]) for r in got) == sorted(want)
    kept = decontamination.decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and kept.count() == sum(n == 0 for _, _, n, _ in want)
    cut = decontamination.decontaminate(docs, bench, mode="spans", block_bytes=block_bytes)
    assert cut.count() == docs.count() and sum(len(ALNUM.findall(low(t))) for _, t in rows_of(cut)) == sum(n - h for _, n, h, _ in want)
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, bench, mode="x")


@pytest.mark.parametrize("block_bytes", [1 << 20, 300, 40])
def test_hit_documents_side_by_side_are_hit_to_their_ends(spark, block_bytes):
    """A hit that ends with a document takes nothing from the one that follows, however many lie in one partition."""
    import random

    r = random.Random(8)
    items = [(i, sentence(r, k)) for i, k in enumerate([10, 3, 12, 30, 1, 10])]
    docs = spark.createDataFrame([(i, t) for i, t in items for _ in range(2)] + [(99, sentence(r, 9))], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r["__n_hits"], r["__hit_words"]) for r in decontamination.hit_spans(docs, bench, block_bytes=block_bytes).collect()}
    assert all(got[i] == (len(t.split()), len(t.split())) for i, t in items)


# top-k


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(impact_topk, "BLOCK", 16)
    monkeypatch.setattr(impact_topk, "QUERY_BYTES", 200)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(90)] + [(200, [1.0, 2.0]), (250, [3.0, 1.0]), (300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (400, [0.0] * 6), (7, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    got = impact_topk.top_k(impact_topk.build(df), df.where("vec_id % 50 = 0"), 5)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert impact_topk.top_k(impact_topk.build(df.limit(0)), df.limit(0), 5).collect() == []


def test_fewer_components_are_touched_than_by_a_dense_product():
    r = np.random.default_rng(8)
    v = np.floor(256 * r.normal(size=(20_000, 64)) / 8).astype(np.int64)
    queries, ids = v[::200], np.arange(0, 20_000, 200)
    best, touched = impact_topk.Best(len(ids), 5), 0
    lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, 64, dtype=np.int32), v.ravel())
    for batch in impact_topk._index(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), lists], names=["vec_id", "v"])])):
        block = impact_topk.Block({x: c[0].as_py() for x, c in zip(batch.schema.names, batch.columns, strict=True)})
        best.add(*block.best(queries, ids, 5, best.floor))
        touched += block.touched
    assert touched < 0.75 * v.size * len(ids)
    exact = v @ queries.T
    exact[ids, np.arange(len(ids))] = -(1 << 60)
    for q in range(len(ids)):
        assert best.rows[1][best.rows[0] == q].tolist() == np.lexsort((np.arange(len(v)), -exact[:, q]))[:5].tolist()


# license scan


def test_license_phrases_and_templates(spark):
    rows = [(1, "Licensed under the MIT License."), (2, "x CC BY cc-by general public license ALL rights reserved all rights"), (3, "cc  by cc by"), (4, "licensed under the brand new mit license today"), (5, "licensed to you"), (6, "cc byx acc by")]
    got = {r.doc_id: r for r in license_scan.scan(awkward(spark, rows)).collect()}
    assert (got[1].labels, got[1].score, got[1].n_base, got[1].first_word) == ("mit", 1.0, 0, None)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (13, 4, 1, 8, "cc-by,gpl,reserved")
    assert (got[3].n_base, got[3].labels) == (2, "cc-by") and got[5].labels == "" and got[6].n_base == 0
    assert 0 < got[4].score < 1
    assert (got[900].n_words, got[900].labels, got[900].score) == (0, "", 0.0) and got[901].n_words == 0
    docs = awkward(spark, rows)
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.template_grams(spark, [("x", "too short")])


def test_long_templates_and_bounded_drift(spark):
    import random

    r = random.Random(3)
    whole = [f"{w}{r.randint(0, 99)}" for w in r.choices(WORDS, k=400)]
    twice = whole[:200] + ["more"] + whole[200:]
    drifting = [x for i, w in enumerate(whole) for x in ((w, "and") if i % 40 == 39 else (w,))]
    rows = [(1, " ".join(whole)), (2, "x " + " ".join(twice) + " y"), (3, " ".join(drifting)), (4, " ".join(whole[:90]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in license_scan.scan(docs, templates=[("whole", " ".join(whole))]).collect()}
    assert (got[1].labels, got[1].score, got[2].labels) == ("whole", 1.0, "whole") and got[2].score > 0.99
    assert got[3].labels == "" and 0.3 < got[3].score < 0.5 and got[4].labels == "" and 0.2 < got[4].score < 0.25


# language ID


def test_language_evidence(spark):
    import random

    r = random.Random(9)
    kinds = {"xx": "abcde", "yy": "vwxyz"}
    text = lambda k, n: " ".join("".join(r.choices(kinds[k], k=4)) for _ in range(n))
    rows = [(i, text("xx" if i % 2 else "yy", 30), "xx" if i % 2 else "yy", "a.site.xx" if i % 2 else "b.site.yy") for i in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(train, sample=100)
    held = spark.createDataFrame([(i, text("xx" if i % 2 else "yy", 8), "xx" if i % 2 else "yy", "c.site.xx") for i in range(1000, 1200)], train.schema)
    got = language_id.judged(held, model, host=F.col("source")).join(held, "doc_id")
    assert got.where("language = lang").count() >= 198
    odd = spark.createDataFrame([(1, "", "xx", None), (2, None, None, "a"), (3, "12 34 56", "yy", None), (4, "ac", None, "a.site.xx"), (4, "ac", None, "a.site.xx"), (5, "日本語のテキスト" * 9, None, None)], train.schema)
    both = train.unionByName(odd)
    found = {r.doc_id: r for r in language_id.judged(both, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert not found[1].accepted and not found[2].accepted and found[3].language == "yy" and found[4].language == "xx" and not found[5].accepted
    assert {r.doc_id for r in train.collect()} <= {r.doc_id for r in language_id.accepted(both, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert language_id.judged(odd.limit(0), model).count() == 0
    unlabelled = language_id.fit(odd.limit(0))
    assert language_id.judged(odd, unlabelled).where("language <> 'und' or not accepted").count() == 0
    assert language_id.accepted(odd, unlabelled).count() == odd.count()
    page = spark.range(1).select(language_id.html_language(F.lit("<!doctype html><HTML class=a lang='de-AT'>")).alias("l")).first()
    assert page.l == "de"


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"), sample=300)
    held = docs.where("doc_id % 2 = 1")
    right = language_id.judged(held, model, host=F.col("source")).join(held, "doc_id").where("language = lang").count()
    assert right >= 0.97 * held.count()


# line dedup


def edit_distance_at_most_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_lines(rows, least=8):
    lines = sorted((i, n, tuple(SPACE.findall(x))) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n")))
    gone, seen = set(), []
    for i, n, w in lines:
        if w and any((j, m) < (i, n) and (v == w or (len(w) >= least and len(v) >= least and edit_distance_at_most_one(v, w))) for j, m, v in seen):
            gone.add((i, n))
        seen.append((i, n, w))
    return gone


def test_one_edit(spark):
    import itertools

    words = [list(x) for n in range(1, 5) for x in itertools.product([1, 2], repeat=n)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a array<long>, b array<long>")
    for r in pairs.select("a", "b", line_dedup._one_edit(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == edit_distance_at_most_one(r.a, r.b)


@pytest.mark.parametrize("least", [8, 2])
def test_lines_equal_brute_force(spark, least):
    import random

    r = random.Random(12)
    base = [sentence(r, k) for k in (1, 2, 5, 7, 8, 9, 12, 20, 33)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = [r.choice([*WORDS, "new"])] * r.randint(0, 1)
            out.append(r.choice([" ", "  ", "\t"]).join(w) + r.choice(["", " ", "\r"]))
        rows.append((i, "\n".join([*out, ""] * r.randint(1, 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.line_no) for x in line_dedup.repeated_lines(docs, least_words=least).collect()}
    want = brute_lines(rows, least)
    assert got == want and len(want) > 50
    texts = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs, least_words=least).collect()}
    for i, t in rows:
        assert texts[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)


def test_awkward_lines(spark):
    docs = awkward(spark)
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "__n_lines", "__n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[900].text is None and got[900]["__n_lines"] == 0 and got[901].text == "" and got[902].text == "  \n "
    assert got[904]["__n_removed"] == 0 and got[905]["__n_removed"] == 400 and got[906].text == "" and got[None]["__n_removed"] == 0
    kept = line_dedup.dedup_lines(docs, drop_emptied=True)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [900, 901, 902, 903, 904, 907, 908]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# substring dedup


def brute_substrings(rows, k):
    first = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        for n in range(len(w) - k + 1):
            if i is not None:
                first[tuple(w[n : n + k])] = min(i, first.get(tuple(w[n : n + k]), i))
    out = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = set()
        for n in range(len(w) - k + 1):
            if i is not None and first[tuple(w[n : n + k])] < i:
                gone |= set(range(n, n + k))
        out.append((str(i), len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed,vocabulary", [(1, 2), (2, 6), (3, 1000), (4, 30)])
def test_substrings_equal_brute_force(spark, seed, vocabulary):
    import random

    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [" ".join(r.choices(words, k=r.randint(10, 70))) for _ in range(5)]
    rows = [(i // 2 if i % 9 == 0 else i, " ".join(r.choice([r.choice(passages), " ".join(r.choices(words, k=r.randint(1, 30)))]) for _ in range(r.randint(1, 6)))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = debruijn.dedup_substrings(docs, window=20, anchor=6)
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept) for x in got.collect()) == brute_substrings(rows, 20)


def test_awkward_substrings(spark):
    docs = awkward(spark, near_copies(5, copies=4))
    got = debruijn.dedup_substrings(docs).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept) for x in got) == brute_substrings(rows_of(docs), 50)
    assert debruijn.dedup_substrings(docs.limit(0)).count() == 0
    x = np.random.default_rng(0).integers(0, 99, 200)
    for n in (1, 2, 3, 35):
        assert debruijn.sliding_min(x, n).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]
