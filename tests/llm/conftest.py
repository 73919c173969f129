from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty, short, repeated, very long, non-ASCII texts; ties; names that the operators use inside.
AWKWARD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "One", None, "a", 3),
    (4, "one two", "en", None, 7),
    (5, "the quick brown fox jumps over the lazy dog " * 30, "en", "b", 1),
    (5, "the quick brown fox jumps over the lazy dog " * 30, "en", "b", 1),
    (6, "the quick brown fox jumps over the lazy dog " * 30, "en", "b", 1),
    (None, "row without id, mail a.b@example.org and 192.168.1.1", "en", "b", 1),
    (None, None, None, None, None),
    (7, "äöü \U0001f600 日本語 <s> </s> <unk>  　 tab\there\nline\x0b\x0c\r end", "de", "c", 1),
    (8, "x" * 50_000, "en", "c", 1),
    (9, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "c", 1),
    (10, "call +49 30 1234567-89 or pay 4111 1111 1111 1111, 256.1.1.1 or 10.0.0.255.7", "de", "c", 1),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, DOCS)
    for c in ("_key", "_s", "_kept", "_row", "fp", "size", "target", "_nth", "score", "item_id", "_id"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
