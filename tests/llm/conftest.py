import pytest


#: Names that helpers might take, and ones that need quotes.
CLASHES = (
    "__id", "__n", "__text", "__gone", "__k", "__hot", "__by", "__size", "__class", "own_digest", "own_mark", "own_size", "own_class", "drop_id", "drop_mark", "drop_class", "gone", "nth",
    "m_k", "m_copy", "m_rows", "g_n", "g_key", "g_top", "c0", "c1", "t", "name", "copy", "place", "root", "best", "a.b", "a`b", "a b", "n_ids", "lossless", "held_out", "cover_5",
)


@pytest.fixture(scope="session")
def docs(spark):
    """A few documents with nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word59", "other")
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", None, 1), (4, None, None, None, None), (5, "", "en", "b", 0),
        (6, "one two", "en", "b", 7), (7, "One TWO", "fr", "b", 7), (None, "alone text here", "en", "c", 3), (8, "x " * 20000, "en", "c", 40000),
        (9, "line one is here\n" * 30, "en", "c", 10), (10, "   \n\t ", "de", "d", 5), (11, "This is under the MIT-License, ok. Mit license", "en", "d", 9),
        (12, "one id, this text", "en", "d", 4), (12, "one id, that text", "en", "d", 4),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumn("kept", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("class", F.lit(2)).withColumns({c: F.lit(3) for c in ("rows", "copies", "bucket", "digest", "mark", "top", "shard", "size", "line", "ids", "label", "g")}).withColumns({c: F.lit("own") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
