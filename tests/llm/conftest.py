import pytest

from llm_helpers import CLASHING, PROSE


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, repeats, and columns with clashing names."""
    long = " ".join(f"word{i % 997} Überlänge, naïve." for i in range(40_000))
    texts = [(1, PROSE), (1, PROSE), (None, PROSE), (2, None), (None, None), (3, ""), (4, long), (5, "\n\n \x1c\t"), (6, "a\x00b </s> ▁ <|endoftext|> 漢字😀"), (7, PROSE), (7, "another text under the same id")]
    rows = [(i, t, "en", None if k % 3 else f"src{k % 2}", *(f"x{k}" for _ in CLASHING)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
