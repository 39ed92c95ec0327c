import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, kept int, row string, class_id long, hash long"


def words(seed: int, n: int) -> str:
    """Made-up text: n words that depend on the seed only."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns that clash with the operators' own names."""
    base = words(1, 120)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base + " tail words", None, "b"),
        (None, words(2, 80), "de", None),
        (None, base, None, None),
        (5, None, None, "a"),
        (5, None, None, "a"),
        (6, "", "en", "a"),
        (7, " \n\t ", "en", "a"),
        (8, words(3, 30_000), "fr", "a"),
        (9, "a b", "fr", "a"),
        (10, "a b", "fr", "a"),
        (11, "é" * 300 + " " + "é" * 300, "fr", "c"),
        (12, "x " * 400, "fr", "c"),
        (13, words(4, 100) + " " + " ".join(base.split()[20:90]), "de", "c"),
        (14, "12345 !!! 67", "de", "c"),
    ]
    return spark.createDataFrame([(*r[:4], len(r[1] or ""), "x", 0, "r", 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
