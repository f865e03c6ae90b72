import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(folder):
    """(doc_id, text, lang) of the smallest table."""
    t = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"] or "", r["lang"]) for r in t]


@pytest.fixture(scope="session")
def dirty(spark):
    """Rows with nulls, empty texts, a repeated row, ties, a very long text, and extra columns."""
    rows = [
        (1, "", "x", "a"), (2, None, "x", None), (3, " \t\n", None, "c"), (None, "lost id here", "x", "d"),
        (4, "One two three four five six.\nSeven  eight", "x", "e"), (4, "One two three four five six.\nSeven  eight", "x", "e"),
        (5, "ONE two three four five six.\nSeven  eight", "x", "f"), (6, "été ÉTÉ ñ " * 40, "y", "g"),
        (7, "word " * 60000, "y", "h"), (8, "a" * 70000, None, "i"), (9, "<|endoftext|> don't\r\nstop\n\n", "z", "j"),
    ]
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("_hash", "string")
    names = "kept copies row id sha text_sha256 keep_id group_size _copies _copy _id _sha component fp score drop anchor t ord digest words start runs found".split()
    return spark.createDataFrame(rows, schema).selectExpr("*", *[f"_hash as {n}" for n in names])
