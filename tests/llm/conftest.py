from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; documents may have them too.
CLASHING = "tm_hit string, tm_row string, id long, token string, key string, host string, content string, size int, `n words` int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty and blank texts, a very long text and word, repeated rows and ids."""
    r = random.Random(5)
    long_text = words(r, 60_000)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, None),
        (None, words(r, 40), "en", "a", 1),
        (None, None, None, None, None),
        (4, long_text, "en", "b", len(long_text)),
        (5, "x" * 300_000, "en", "b", 300_000),
        (6, words(r, 50), "en", None, 1),
        (7, "one", "en", "c", 3),
        (8, "żółć 日本語 😀   x" * 20, "pl", "c", 1),
    ]
    same = (9, words(r, 80), "en", "a", 5)
    rows += [same, same, (9, words(r, 70), "en", "a", 6), (10, same[1], "en", "a", 5)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    from pyspark.sql import functions as F

    out = odd_docs
    for part in CLASHING.split(", "):
        name, kind = part.rsplit(" ", 1)
        out = out.withColumn(name.strip("`"), F.lit(None).cast(kind))
    return out


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
