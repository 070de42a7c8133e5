import random

import pytest

# names that operators might use inside, all as columns of the input
CLASHES = "words lines row rows size place ranked rank list fp n key part ends lot piece own body set doc span src times label features".split()


@pytest.fixture(scope="session")
def prose():
    """A text of ``n`` words from a vocabulary, the same for the same seed."""

    def make(seed, n, vocabulary=400, line=12):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
        return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, blanks, repeats, ties and a very long text, as ``(doc_id, text, source)``."""
    same = prose(1, 120)
    return [
        (1, same, "a"), (2, same, "b"), (2, same, "b"), (3, same + " tail", None), (4, None, "a"), (None, None, None), (5, "", "a"),
        (6, " \t\n\x0b\x0c\r ", ""), (None, same, "a"), (7, "one", "b"), (8, "É ü\u00a0x \u2028 y", "c"), (9, prose(2, 60_000), "c"),
        (10, "same " * 500, "a"), (11, "same\n" * 300, "a"), (12, prose(3, 90), "é"), (12, prose(4, 90), "é"), (-3, prose(3, 90), "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(odd_rows, "doc_id long, text string, source string")
    return table.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
