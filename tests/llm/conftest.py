import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(7)
    base = words(rng, 120)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, 5), (4, base, "en", "b", 1), (4, base, "en", "b", 1), (5, base, "en", "b", 1), (6, base + " tail", "en", None, 1),
        (7, words(rng, 30_000), "de", "c", 1), (8, "é ß 日本 \U0001f600 á", "fr", "a", 1), (9, "x", "en", "a", 1), (10, "x x x x x x x x x", "en", "a", 1), (None, "no id here", "en", "a", 1), (11, "Released under the MIT License.", "en", "zz", 1),
    ]
    return rows + [(20 + k, words(rng, rng.randint(1, 200)), "en", rng.choice("abc"), 1) for k in range(40)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """With extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    extra = ("size", "score", "shard", "mixed", "h", "n_shingles", "sketch", "piece", "fingerprint", "part", "target", "_row", "copies")
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
