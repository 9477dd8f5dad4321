import pytest

LONG = "word " * 60_000 + "tail"
#: id, text, lang, source, n_chars, and columns whose names operators use inside.
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", None, 4),
    (4, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (5, "the quick  brown fox jumps over the lazy DOG", "en", "b", 43),
    (6, "one two", None, "b", 7),
    (6, "one two", None, "b", 7),
    (7, LONG, "en", "c", len(LONG)),
    (8, LONG, "en", "c", len(LONG)),
    (None, "text without an id, which is all right as well", "en", "c", 46),
    (9, "12 34 --- 56", "en", "a", 12),
    (10, "Grüße über die schöne Straße, naïve café", "de", "a", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["row", "size", "hash", "shard", "label", "words", "n_words", "score", "band", "target", "cell", "slot", "content", "draw"]


@pytest.fixture(scope="session")
def edges(spark):
    """Rows with nulls, blanks, repeats, one very long text twice, and clashing columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def none(edges):
    return edges.filter("1 = 0")


@pytest.fixture(scope="session")
def frame(spark):
    """A table of (doc_id, text) from texts."""
    return lambda *texts: spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
