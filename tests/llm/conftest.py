import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, h long, salt int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, a very long one, repeated rows, equal texts, a null id, clashing names."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeéß'", k=rng.randint(1, 7)))
    long = " ".join(word() for _ in range(30_000))
    passage = " ".join(word() for _ in range(80))
    texts = [None, "", " \n\t ", long, passage, passage, f"x {passage} y", "one two", "one two", "<|endoftext|> a<|endoftext|>", "tail  ", "x" * 5000, "😀 中文 «naïve» z", "it's we're 1,234.5!!  \n\n  end"]
    rows = [(i, t, "en" if i % 2 else None, "s", None, "w", "q", 3, 1) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[1], (None, "no id here", None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(2)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
