import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and blank texts, repeated rows, long texts, other scripts and clashing columns."""
    long = " ".join(f"w{i % 977}x{i % 131}" for i in range(30000))
    passage = " ".join(f"passage{i}" for i in range(60))
    line = "A line that is long enough to be counted"
    texts = [
        None, "", "   \t\n", "one", "two words", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΟΔΟΣ naïve e\u0301 日本語 テスト １２ \U0001f600", "x\x1cy\x85z\u3000q",
        long, long, long + " end", passage, "before " + passage + " after", passage.upper(), " ".join(["a", "b"] * 40), f"{line}\nown 1", f" {line.upper()} \r\nown 2\n{line}", f"x\n\n{line}", f"{line}",
        "Same words in the same order stand here twice over", "same words IN the same order stand here twice over", "###*** $$$ %%%",
    ]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2) for i, t in enumerate(texts)]
    rows += [(19, texts[19], "en", "s", 5, 1, 2), (None, "a row without an id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept long").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("en").alias("lang"))

