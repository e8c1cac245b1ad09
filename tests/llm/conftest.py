import random

import pytest

VOCABULARY = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name clashes with what operators use inside."""
    rng = random.Random(3)
    long = text(rng, 30_000)
    rows = [(1, None, "a"), (2, "", "b"), (3, "  \n \n", None), (None, "some text without an id, twelve words or so in it", "c"), (4, "x", "d"), (5, long, "e"), (5, long, "e"), (6, long[:150_000], "f"), (7, "é ü ß 漢字 ́ end", "g"), (8, "12 34 56", "h")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")
