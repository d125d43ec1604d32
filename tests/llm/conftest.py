import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


#: Columns that the operators add or use themselves.
CLASHES = ("score", "kept", "shard", "slot", "contaminated", "coverage", "n_tokens", "key", "part", "start", "block", "range", "n", "ids", "lang_pred", "n_words", "_row", "_key", "root", "train", "edits2")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names clash."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and goes home again", "en", "a", 63),
        (1, "the quick brown fox jumps over the lazy dog and goes home again", "en", "a", 63),
        (2, "THE quick brown fox jumps over the lazy dog and goes home again", "en", None, 63),
        (3, None, "en", "a", None),
        (4, "", None, "a", 0),
        (5, " \t\n ", "en", "a", 4),
        (None, "ein kurzer Text mit Wörtern", "de", "b", 27),
        (None, None, None, None, None),
        (6, long_text, "de", "b", len(long_text)),
        (7, "one two", "en", "b", 7),
        (8, "#$%& 12345 |||", None, "b", 14),
        (9, "a b c 漢字 \U0001f600 é", "en", "b", 14),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    made = spark.createDataFrame(rows, schema)
    for c in CLASHES:
        made = made.selectExpr("*", f"'own' AS {c}")
    return made


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
