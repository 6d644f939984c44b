import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    passage, long = words(rng, 90), words(rng, 30_000)
    rows = [
        (1, words(rng, 50) + " " + passage, "en", "a"), (2, passage + " " + words(rng, 40), "en", "a"), (3, None, "en", "a"), (4, "", "en", None), (5, " \n\t ", None, "a"),
        (6, long, "en", "b"), (7, passage, "en", "b"), (7, passage, "en", "b"), (8, passage, None, None), (None, passage, "en", "b"), (None, None, None, None),
        (9, "Heat " * 300, "en", "c"), (10, "é" * 900, "fr", "c"), (11, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and АБВГД', "en", "c"), (12, long[: len(long) // 2], "en", "c"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "7 AS row", "'x' AS id", "0 AS fp", "0 AS label", "1 AS score", "2 AS anchor", "3 AS found").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
