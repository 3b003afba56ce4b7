import pytest

CLASH = ["size", "keep_id", "shard", "salt", "digest", "norm", "rank", "text_sha256", "kept", "n", "set", "bits",
         "token", "block", "spans", "times", "anchor", "route", "start", "target", "taken", "shards", "quota",
         "words", "rule", "_s", "_t", "_id", "_rank", "_b", "group_size", "component_id", "text_hash", "ids"]
LONG = "".join(f"word{i % 977}x{i % 31} " for i in range(40_000))  # 400,000 characters

ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "de", None, 4), (4, LONG, "en", "b", len(LONG)),
    (5, "Same text of some words here", "en", "a", 28), (6, "same TEXT of some words here", None, "a", 28),
    (6, "same TEXT of some words here", None, "a", 28), (7, "Same text of some words here", "en", None, None),
    (None, "no id at all", "en", "c", 12), (None, None, None, None, None), (8, "É é Same", "fr", "c", 8),
    (9, "one", "en", "b", 3), (10, "mail me@example.com now", "en", "b", 23),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, and extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"extra {c}") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest table, as {doc_id: text}."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


SF = "/root/testdata/sf0.001"
