import pytest

#: Null and empty texts, white space only, ties, repeated rows, missing and repeated ids, marks and long words.
ODD = [
    (1, None), (2, ""), (3, " \t\n \n"), (4, "one"), (5, "One TWO\n three\x0bfour\r\n\nfive"), (6, "ä€𝄞 ÄÖ #5 $7"),
    (7, "same text here " * 30), (8, "same text here " * 30), (9, "same text here " * 30 + "end"), (9, "same text here " * 30 + "end"),
    (None, "no id " * 40), (None, None), (10, "other text for the id"), (10, "and another text for it"), (11, "x" * 3000),
    (12, "ab" * 900), (13, "\\ <|endoftext|> </turn> ### \u0000  "),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def odd_wide(spark):
    """The odd rows with further columns, named as operators name theirs."""
    rows = [(t, d, "en" if i % 2 else None, i, 1, "k", "z") for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "text string, doc_id long, lang string, chunk int, n_lines int, keep string, ids string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def words():
    """Invented prose from a seed."""
    import random

    def make(seed, n):
        pick = random.Random(seed)
        return " ".join("".join(pick.choice("aeioustrnl") for _ in range(pick.randint(2, 6))) for _ in range(n))

    return make
