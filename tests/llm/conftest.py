import pytest

ODD_TEXTS = [None, "", " ", "\n\n \t", "word", "one two three", "<s> ▁ 中文 😀 é", "a" * 3000, "x y " * 3000, "Tab\tand\x0bfeed\x0c end\r\n"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", f"src{i % 2}", None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[4], (None, "word", "en", None, 4), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ("kept", "component_id", "rep", "key", "hash", "spans", "shard", "ids", "value", "list", "unit", "score", "bucket", "sequence_id", "_before", "_place", "_hash", "_spans", "_refused", "_id", "_target", "_piece", "_window", "_key", "place", "held", "piece", "window", "id", "text_hash", "found", "row", "term", "rank", "low", "high", "toxic", "good")
    return df.selectExpr("*", *(f"'extra' AS {n}" for n in names))


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
