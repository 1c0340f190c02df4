import random

import pytest

WORDS = "the of and river stone light under walks seven green table paper north winter small bright old carry horse field".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", str(rng.randrange(50))]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows as (doc_id, text, source): nulls, empty and long texts, ties, copies and repeated rows."""
    rng = random.Random(3)
    base = prose(rng, 200)
    near = base.split()
    near[50] = "changed"
    long = prose(rng, 6000)
    passage = prose(rng, 70)
    rows = [
        (1, base, "a"), (2, base, "b"), (2, base, "b"), (3, " ".join(near), None), (4, None, "a"), (5, "", "a"), (None, base, "a"),
        (None, "two words", None), (6, "two  words", "b"), (7, " \t\n ", "b"), (8, long, "a"), (9, long + " tail", "c"),
        (10, "x" * 4000, "c"), (11, "x" * 3000, "c"), (12, "was " * 300, "é"), (13, "was " * 300 + "not", "é"),
        (14, prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 30), "z"), (15, prose(rng, 20) + "\n" + passage + " \n" + prose(rng, 80), "z"),
        (16, "Été à la mer 😀 " * 12, "a"), (17, "Été à la mer 😀 " * 11 + "fin", "a"), (18, "A line of text here\na LINE of text here \n\n", "a"),
        (19, "a line of text here", "b"), (20, "UPPER " + base.upper(), "b"),
    ]
    rows += [(100 + i, prose(rng, rng.choice([0, 1, 2, 5, 49, 50, 51, 120])), rng.choice("abc")) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names clash with outputs and inner names."""
    wide = [(*row, 7, "x", 1.5, "kept") for row in odd_rows]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, n_tokens long, rule string, size double, kept string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
