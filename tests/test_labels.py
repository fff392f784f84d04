import pytest
from pyspark.sql import functions as F

from splitlens.functions import labels
from splitlens.functions.similarity import common_subsequence, indel_ratio, indel_ratio_of, packed, tanimoto


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "text,number,key",
    [(" 1 ", 1.0, "1.0"), ("1.0", 1.0, "1.0"), ("NA", None, None), ("x", None, "x"), ("1d", None, "1d"), ("1_000", 1000.0, "1000.0"), ("-2.5e1", -25.0, "-25.0"), ("nan", None, None), ("", None, None), (None, None, None), ("-0", 0.0, "0.0"), (".5", 0.5, "0.5"), ("5.", 5.0, "5.0")],
)
def test_labels_are_read_as_numbers_where_they_spell_one(spark, text, number, key):
    n, k = labels.coerced(F.lit(text).cast("string"))
    assert tuple(one(spark, n.alias("n"), k.alias("k"))) == (number, key)


def test_equal_labels_have_equal_keys_whatever_their_type(spark):
    df = spark.sql("select 1 as a, 1.0D as b, '1' as c, true as d")
    keys = {r for c in df.columns for r in [labels.with_labels(df, [c]).first().label_key[0]]}
    assert keys == {"1.0"}


def test_missing_scalar_label_is_an_array_with_null(spark):
    df = spark.sql("select cast(null as string) as a, array(1.5D, cast('nan' as double)) as v, array(array(1), array(2, null)) as w")
    assert labels.with_labels(df, ["a"]).first().label_key == [None]
    assert labels.with_labels(df, ["v"]).first().label_num == [1.5, None]
    assert labels.with_labels(df, ["w"]).first().label_num == [1.0, 2.0, None]


def test_deltas_and_thresholds(spark):
    a, b = F.array(F.lit(1.9), F.lit(None).cast("double")), F.array(F.lit(-1.9), F.lit(1.0), F.lit(3.0))
    r = one(spark, labels.classification_delta(a, b).alias("c"), labels.regression_delta(a, b).alias("r"))
    assert r.c == [2.0, None, None] and r.r == [3.8, None, None]
    d = lambda *x: F.array(*[F.lit(v).cast("double") for v in x])
    r = one(spark, labels.exceeds(d(3.0), d(3.0)).alias("at"), labels.exceeds(d(2.9), d(3.0)).alias("below"), labels.exceeds(d(9.0), d(0.0)).alias("off"), labels.exceeds(d(None, 1.0, 5.0), d(9.0, 4.0)).alias("last"), labels.exceeds(d(None), d(1.0)).alias("null"))
    assert tuple(r) == (True, False, False, True, False)


def test_split_names_and_slugs(spark):
    values = [" Train", "VAL", "valid", "test ", "dev", None]
    r = one(spark, *[labels.split_name(F.lit(v).cast("string")).alias(f"c{i}") for i, v in enumerate(values)])
    assert tuple(r) == ("train", "valid", "valid", "test", None, None)
    assert tuple(one(spark, labels.slug(F.lit(" a/b  c--d?")).alias("s"), labels.slug(F.lit("??")).alias("e"))) == ("a-b-c-d", None)


def test_published_ratio_and_brute_force(spark):
    assert indel_ratio_of("CCCCCCCO", "CCCCCCCCCCCCCCCCCCO") == pytest.approx(16 / 27)
    assert one(spark, indel_ratio(F.lit("CCCCCCCO"), F.lit("CCCCCCCCCCCCCCCCCCO")).alias("r")).r == pytest.approx(16 / 27)
    import random

    r = random.Random(3)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(500):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 80))) for _ in range(2))
        assert common_subsequence(a, b) == slow(a, b)


def test_tanimoto_and_packing(spark):
    s = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<int>")
    r = one(spark, tanimoto(s(1, 2, 3), s(2, 3, 4)).alias("h"), tanimoto(s(), s()).alias("e"), tanimoto(s(1), s()).alias("z"), packed(s(0, 3, 64, 127), 128).alias("p"))
    assert (r.h, r.e, r.z) == (0.5, 1.0, 0.0)
    assert r.p == [9, (1 | 1 << 63) - (1 << 64)]


def test_common_subsequences_of_any_length_equal_the_table():
    import random

    from splitlens.functions import similarity

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    r = random.Random(3)
    some = lambda: "".join(r.choices("abé中😀", k=r.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 200])))
    a, b = [some() for _ in range(120)], [some() for _ in range(120)]
    want = [table(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.common_subsequences(a, b).tolist() == want
    similarity._CELLS, before = 500, similarity._CELLS
    try:
        assert similarity.common_subsequences(a, b).tolist() == want
    finally:
        similarity._CELLS = before
    assert similarity.common_subsequences([], []).tolist() == []
    assert similarity.common_subsequence("a" * 3000 + "b", "b" + "a" * 2900) == 2900
