import pytest

#: Nulls, empty and blank texts, repeated rows, a very long text, case and non-ASCII letters, white space of every kind.
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ROWS = [
    (1, None), (2, ""), (3, "  \t\n"), (4, "One two three four five six seven eight nine ten eleven twelve."), (5, "ONE two three four five six seven eight nine ten eleven twelve."),
    (5, "ONE two three four five six seven eight nine ten eleven twelve."), (6, LONG), (7, LONG + "x"), (8, "É à la carte\x0bÉté"), (9, "É à la carte\x0bÉTÉ"),
    (None, "one two"), (10, "short"), (11, "tie"), (12, "tie"), (13, "\U0001F600 smile\r\nline\x1fend"), (14, "a\n" * 50), (None, None),
]
CLASHING = ["n", "h", "p", "g", "kept", "shard", "label", "host", "run", "row", "key", "recipe", "window", "band", "score", "items"]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with odd rows and columns named as the operators' own."""
    rows = [(i, t, *["clash"] * len(CLASHING)) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
