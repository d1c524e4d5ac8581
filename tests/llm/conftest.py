import pytest
from pyspark.sql import functions as F

#: Texts that every operator over texts must take.
TEXTS = [
    None, "", " \n\t ", "one", "One two  three", "a b c d e f g", "a b c d e f g", "Élan ß   x́ \x01 y",
    "<|endoftext|> a <|ENDOFTEXT|>", "x" * 5000, "word " * 3000, "the quick brown fox jumps over the lazy dog . " * 40,
]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Odd texts with a repeated row, a repeated id, a NULL id, and columns whose names clash with results."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (4, "another text with this id"), (None, "no id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("score", "n_words", "fp", "slot", "component", "content", "Spans", "start", "length", "order",
                 "predicted", "items", "n_tokens", "row", "digest", "body", "positive"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.where("false")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
