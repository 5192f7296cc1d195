import pytest

SCHEMA = "text string, doc_id long, lang string, source string, size int, row int, bucket string, target string, rank int, accepted boolean, score string, kept int, n_dropped string, drop int, fp string, component_id int, off int, taken int, spans int, kind string, k1 string, b int, least string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
    passage = "the quick brown fox jumps over the lazy dog and " * 8
    rows = [
        ("", 1, "en", "a"), (None, 2, None, None), (long, 3, "en", "a"), ("Von.", 4, "de", None), (passage + "x", 5, "en", "b"), (passage + "y", 6, "en", "b"),
        (passage + "y", 6, "en", "b"), ("...", 7, "en", "a"), ("a b", None, "en", "a"), (None, None, None, None), (None, None, None, None), ("é\U0001f600 中文 a@b.co\n" * 3, 9, "fr", "c"),
        ("line one is long enough to count\n" * 2, 10, "en", "a"), ("LINE ONE is long enough to count ", 11, "en", "a"), ("\tline one is long enough to count\nx", 12, "en", "a"),
    ]
    return spark.createDataFrame([(*r, 7, 8, "x", "y", 9, False, "s", 1, "n", 2, "f", 3, 4, 5, 6, "k", "k", 7, "l") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
