import random

import pytest
from pyspark.sql import functions as F

from splitlens.operators import structures
from splitlens.operators.alignment import BLOSUM62_LETTERS, CLOSE, GramIndex, Scoring, _search, align, best_alignments, blosum62, nearest_sequences
from splitlens.plans import queries


def test_empty_sides_and_equal_strings():
    assert align("", "ABC")[:3] == (0.0, 0.0, 0.0) and align("", "ABC")[5] == 100.0
    r = align("ACDEFG", "ACDEFG")
    assert r[1] == r[2] == 100.0 and r[0] == 36.0 and r[4] == 0


def test_scores_equal_a_plain_recursion():
    s, r = Scoring(gap_open=3, gap_extend=1), random.Random(2)

    def slow(a, b):
        low = -1e9
        m = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
        x = [row[:] for row in m]
        y = [row[:] for row in m]
        m[0][0] = 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i and j:
                    m[i][j] = max(m[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1]) + s.score(a[i - 1], b[j - 1])
                if i:
                    x[i][j] = max(m[i - 1][j] - 3, y[i - 1][j] - 3, x[i - 1][j] - 1)
                if j:
                    y[i][j] = max(m[i][j - 1] - 3, x[i][j - 1] - 3, y[i][j - 1] - 1)
        return max(m[-1][-1], x[-1][-1], y[-1][-1])

    for _ in range(150):
        a, b = ("".join(r.choices("ACDE", k=r.randint(1, 12))) for _ in range(2))
        got = align(a, b, s)
        assert got[0] == slow(a, b) and got[6].replace("-", "") == a and got[7].replace("-", "") == b
        assert align(b, a, s)[0] == got[0]


def test_the_first_close_reference_wins(spark):
    rows = [("q", "a", 99.99, 1.0), ("q", "b", 100.0, 9.0), ("p", "x", 50.0, 1.0), ("p", "y", 50.0, 2.0), ("p", "z", 49.0, 9.0)]
    df = spark.createDataFrame(rows, "query string, reference string, identity_pct double, score double")
    assert {r.query: r.reference for r in best_alignments(df).collect()} == {"q": "a", "p": "y"}


def test_nearest_covers_every_query(spark):
    q = spark.createDataFrame([("ACDE",), ("GGGG",), ("ACDE",)], "seq string")
    r = spark.createDataFrame([("ACDE",), ("ACDF",), ("GGGA",)], "seq string")
    assert {x.query: x.reference for x in nearest_sequences(q, r).collect()} == {"ACDE": "ACDE", "GGGG": "GGGA"}


def full_search(query, refs):
    rows = [(x, align(min(query, x), max(query, x))) for x in sorted(refs)]
    close = [x for x in rows if x[1][1] >= CLOSE]
    return close[0] if close else min(rows, key=lambda x: (-x[1][1], -x[1][0], x[0]))


def test_bounds_of_the_gram_index_hold():
    r = random.Random(8)
    refs = sorted({"".join(r.choices("ACD", k=r.randint(0, 14))) for _ in range(60)})
    for query in [*refs[:20], "".join(r.choices("ACDE", k=30)), "A", ""]:
        bounds = GramIndex(refs).bounds(query)
        for x, bound in zip(refs, bounds, strict=True):
            assert align(min(query, x), max(query, x))[1] <= bound or (not query and not x)


@pytest.mark.parametrize("block", [2048, 3])
def test_block_search_equals_a_full_search(spark, block):
    """Families of sequences, equal ones, and one without any like it; blocks of 3 make many cells."""
    r = random.Random(block)
    base = ["".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=r.randint(20, 60))) for _ in range(8)]
    vary = lambda s: "".join(r.choice("ACDY") if r.random() < 0.1 else c for c in s if r.random() > 0.05)
    refs = sorted({vary(r.choice(base)) for _ in range(40)} | {base[0]})
    queries = sorted({vary(b) for b in base} | {base[0], refs[3], "WWWW"})
    q, ref = spark.createDataFrame([(s,) for s in queries] * 2, "seq string"), spark.createDataFrame([(s,) for s in [*refs, None]], "seq string")
    got = {x.query: x for x in nearest_sequences(q, ref, block=block).collect()}
    assert set(got) == set(queries)
    for s in queries:
        want = full_search(s, refs)
        assert (got[s].reference, got[s].score, round(got[s].identity_pct, 9)) == (want[0], want[1][0], round(want[1][1], 9))
    assert nearest_sequences(q, ref.limit(0)).count() == 0 == nearest_sequences(q.limit(0), ref).count()


def test_benchmark_texts_equal_a_full_search(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.q_nn_alignment_texts(spark, sf).collect()
    texts = {x.item_id: "".join((x.text or "").upper().split()) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    test, other = {t for i, t in texts.items() if i % 10 >= 8}, {t for i, t in texts.items() if i % 10 < 8}
    assert {x.query for x in got} == test
    for x in sorted(got, key=lambda x: len(x.query))[:3]:
        want = full_search(x.query, other)
        assert (x.reference, x.score) == (want[0], want[1][0])


def test_few_pairs_of_part_names_are_aligned(spark):
    """Names with kinds and brands: each has others like it, so bounds leave few."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    seqs = part.select(F.upper(F.regexp_replace(F.concat("p_name", "p_type", "p_brand"), " ", "")).alias("seq"), (F.col("p_partkey") % 10 < 8).alias("train")).distinct()
    train, test = seqs.where("train"), seqs.where("not train")
    got, refs = nearest_sequences(test, train).collect(), sorted(x.seq for x in train.select("seq").distinct().collect())
    assert sum(x.n_aligned for x in got) < 0.1 * len(got) * len(refs)
    for x in sorted(got, key=lambda x: x.query)[:4]:
        assert (x.reference, x.score) == (full_search(x.query, refs)[0], full_search(x.query, refs)[1][0])


def test_ties_are_settled_by_all_columns(spark):
    """Names that repeat, dealt over partitions in several ways, give the same rows."""
    r = random.Random(2)
    rows = [(q, r.choice("ab"), r.choice([99.99, 100.0, 50.0]), float(r.randint(0, 1))) for q in "xyz" for _ in range(30)]
    hits = [(r.choice("pq"), r.choice("st"), 1.0, r.choice([0.5, 0.9]), r.random(), 1) for _ in range(40)]
    ids = spark.createDataFrame([(c, c, [s]) for c, s in zip("pqst", ("test", "valid", "train", "train"), strict=True)], "sequence_id string, sequence string, splits array<string>")
    seen = set()
    for k in range(5):
        r.shuffle(rows)
        r.shuffle(hits)
        df = spark.createDataFrame(rows, "query string, reference string, identity_pct double, score double").repartition(k + 1)
        hit = spark.createDataFrame(hits, "query string, target string, score double, probability double, evalue double, line int").repartition(k + 1)
        best = structures.best_hits(hit, ids)
        seen.add((tuple(sorted(map(tuple, best_alignments(df).collect()))), tuple(sorted(map(tuple, best.collect()))), tuple(map(tuple, structures.top_hits(best, 2).collect()))))
    assert len(seen) == 1


def test_matrix_is_symmetric_and_has_its_known_values():
    m = blosum62()
    assert len(m) == len(BLOSUM62_LETTERS) ** 2 and all(m[a, b] == m[b, a] for a, b in m)
    assert (m["W", "W"], m["C", "C"], m["A", "A"], m["I", "L"], m["W", "D"], m["*", "*"], m["X", "X"]) == (11, 9, 4, 2, -4, 1, -1)
    assert align("HEAGAWGHEE", "PAWHEAE")[0] == align("PAWHEAE", "HEAGAWGHEE")[0]


def test_search_equals_a_full_search():
    r = random.Random(5)
    for _ in range(30):
        base = ["".join(r.choices("ACDEFGHIK", k=r.randint(1, 25))) for _ in range(4)]
        refs = sorted({"".join(c for c in r.choice(base) if r.random() > 0.2) for _ in range(12)})
        query = r.choice([*base, *refs])
        rows = [(x, align(min(query, x), max(query, x))) for x in refs]
        close = [x for x, y in rows if y[1] >= CLOSE]
        want = close[0] if close else min(rows, key=lambda x: (-x[1][1], -x[1][0], x[0]))[0]
        assert _search(query, refs, Scoring())[0] == want
