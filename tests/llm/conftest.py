import pytest

CLASH = "row_id string, t string, a string, b string, h string, item long, key long, c string, base string, found string, fp long, host string, gone string, size int"


@pytest.fixture(scope="session")
def odd(spark):
    """documents with nulls everywhere, empty and very long texts, repeated rows, and columns that clash with inner names."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "plain words that make a short text of ten words or so", "en", "src0", 54),
        (1, "plain words that make a short text of ten words or so", "en", "src0", 54),
        (2, None, None, None, None),
        (3, "", "en", "src1", 0),
        (4, " \n\t ", "en", "src1", 4),
        (5, long, "en", "src0", len(long)),
        (6, "ÉTÉ 'S <|endoftext|> Σ 日本語 a\x1cb", "fr", "src2", 30),
        (None, "no number", "en", "src0", 9),
    ]
    extra = tuple([None] * 14)
    return spark.createDataFrame([r + extra for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
