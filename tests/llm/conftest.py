import pytest

#: Texts that every operator must take: null, empty, white space, short, tied, long, odd characters.
LONG = " ".join(f"w{i % 997}" for i in range(6000))
ODD = [None, "", " \t\n\x0b\x0c\r", "one", "a b c d", "The the THE", "é ñ 中文 😀 \x1c \x85\xa0", LONG, "x" * 3000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with null and repeated ids, a repeated row, and columns that clash with results."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (3, "one"), (3, "other text of id three"), (50, LONG), (51, LONG + " end")]
    rows = [(i, t, "c", 1.0, "s", k, "v", "r") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score double, spans string, size long, shard string, cell string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
