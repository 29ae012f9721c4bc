import pytest

ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again today", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "word", "en", "a"),
    (None, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (7, "x" * 3_000 + " " + "y z " * 3_000, "de", "a"),
    (8, "Straße ΣΑΣ \x1c 日本語 😀 <|endoftext|> a  b\n\n c", "de", "c"),
    (9, "same row", "en", "a"),
    (9, "same row", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns with names that operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(0) for c in ("id", "h", "n", "score", "predicted", "bucket", "row", "label", "key", "slot", "uid", "position", "_gone", "_mix_id", "_row_id", "_nth", "a.b")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
