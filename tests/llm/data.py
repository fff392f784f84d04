"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(r, n):
    return " ".join(r.choices(WORDS, k=n))


def near_copies(seed=0, groups=6, copies=7, n=60):
    """(doc_id, text): groups of copies of one text with more or fewer words changed, exact copies among them."""
    r = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"{w}{r.randint(0, 400)}" for w in r.choices(WORDS, k=r.randint(4, n))]
        for c in range(copies):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                words[r.randrange(len(words))] = f"new{r.randint(0, 9999)}"
            if r.random() < 0.3:
                words = words + [f"tail{r.randint(0, 9)}" for _ in range(r.randint(1, 6))]
            rows.append((i, " ".join(words)))
            i += 1
    r.shuffle(rows)
    return rows


def awkward(spark, rows=()):
    """A documents table with every kind of row, and columns whose names operators use inside."""
    long_text = "\n".join(sentence(random.Random(k), 40) for k in range(400))
    extra = [(900, None), (901, ""), (902, "  \n "), (903, "one"), (904, long_text), (905, long_text), (906, long_text), (906, long_text), (None, "a row without an id " * 20), (907, "é中文  x"), (908, "Ab cD ab CD")]
    return spark.createDataFrame([(i, t, "x", 7, 1.5) for i, t in [*rows, *extra]], "doc_id long, text string, rk string, n long, key double")
