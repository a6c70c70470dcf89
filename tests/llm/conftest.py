import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def none(spark):
    """An empty table of documents."""
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, one word, ties, repeated rows, extra columns with likely names."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "epsilon.", "zeta"]) + str(rng.randrange(50)) for _ in range(6000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "b", 0), (3, "word", "en", "a", 4), (3, "word", "en", "a", 4), (None, "some words of no one", None, "a", 3),
        (None, "some words of no one", None, "a", 3), (5, long, "en", None, len(long)), (6, " \t\n ", "de", "", 4), (7, "word", "fr", "b", 4),
        (8, "x" * 5000, "en", "b", 5000), (9, "Ünïcode <|endoftext|> ▁ \x00 text　日本 🙂", "de", "a", None), (-4, "minus four and more words", "en", "c", 2),
    ]
    rows = [(*r, 1.5, "n", 7, 8, [1], "k") for r in rows]
    return spark.createDataFrame(rows, DOCUMENT + ", size double, node string, h int, copies int, bands array<int>, key string")


@pytest.fixture(scope="session")
def vectors(spark):
    """Copies, a scaled copy, vectors that take no part, repeated rows, extra columns."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.1, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.0, 0.0]), (6, None), (7, [1.0, nan, 0.0]),
        (8, [1.0, inf, 0.0]), (9, [1.0, None, 0.0]), (None, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (20, [0.0, 1.0, 0.0]), (21, []), (22, [0.6, 0.8]), (40, [0.6, 0.81]),
    ]
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, node string, dim int")
