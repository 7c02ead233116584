import random

import pytest

WORDS = ["ba", "co", "di", "fu", "ga", "ho", "ki", "lu", "mo", "ne", "pi", "ra", "su", "ta", "vo", "wi", "ye", "zu"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns that clash with working names."""
    long = prose(1, 30_000)
    rows = [(1, "", "en", "a"), (2, None, "en", "a"), (3, "one", None, "b"), (None, "two words", "en", None), (None, None, None, None),
            (4, long, "en", "a"), (5, prose(2, 60), "de", "a"), (5, prose(2, 60), "de", "a"), (6, " \t\n  ", "en", "b"), (7, "***", "en", "b"),
            *[(i, prose(i, 40), "en", "a") for i in range(10, 40)]]
    df = spark.createDataFrame([(*r, 9, "x", "y", 1.0) for r in rows],
                               "doc_id long, text string, lang string, source string, tokens int, shard string, class string, score double")
    return df


@pytest.fixture(scope="session")
def no_rows(odd_rows):
    return odd_rows.limit(0)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 40)] + [(None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
