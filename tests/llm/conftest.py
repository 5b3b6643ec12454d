import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "src0", 0),
        (3, " \n\t ", "en", "src0", 4),
        (4, "one two three four five six seven eight nine ten eleven twelve", "en", "src1", 60),
        (5, "one two three four five six seven eight nine ten eleven twelve", "en", "src1", 60),
        (5, "one two three four five six seven eight nine ten eleven twelve", "en", "src1", 60),
        (None, "one two three four five six seven eight nine ten eleven twelve", None, "src1", 60),
        (6, long, "fr", "src2", len(long)),
        (7, "x" * 5000, "fr", "src2", 5000),
        (8, "\u0001 a@b.co \u0001 Ünïcödé 漢字 🙂 <|endoftext|> 's It's", "de", "src3", 30),
    ]
    full = [(*r, "k", "fp", 7, [1]) for r in rows]
    return spark.createDataFrame(full, SCHEMA + ", kept string, fp string, size int, words array<int>")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
