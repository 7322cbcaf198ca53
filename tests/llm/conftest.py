import pytest
from pyspark.sql import functions as F

TEXTS = [
    "the quick brown fox jumps over the lazy dog near the river bank today\nA second line of words here",
    "the quick brown fox jumps over the lazy dog near the river bank today\nA second line of words here",
    None, "", "   \n\t\n", "word", "12 34 !!", "Ünïcödé wörds äre fïne hère\n\nnaïve café",
    " ".join(f"w{i % 997}" for i in range(30_000)),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and repeated ids, null, empty, blank and very long texts, clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[0], None, None), (None, None, "en", "s1"), (1, TEXTS[1], "en", "s1"), (1, "other words under one id", "de", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "doc": F.lit(1), "node": F.lit("x"), "size": F.lit(2),
                           "numbers": F.lit(3), "rank": F.lit(4), "words": F.lit(5), "label": F.lit(6), "_doc": F.lit(7)})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    """The small given tables."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
