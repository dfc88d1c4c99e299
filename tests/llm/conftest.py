import pytest

#: Rows that every operator must live with: nulls in each column, empty and very long texts, ties and repeated rows, and columns whose names operators might use themselves.
LONG = "word " * 40_000 + "x" * 50_000
DOCS = [
    (1, "the cat sat on the mat today", "en", "a", "x", 0.5), (2, "the cat sat on the mat today", "en", "a", "x", 0.5), (3, None, "en", "a", "x", 0.5), (4, "", None, None, "x", 0.5), (5, LONG, "en", "b", None, None),
    (6, "der Hund läuft über die Straße", "de", None, "x", 0.5), (6, "der Hund läuft über die Straße", "de", None, "x", 0.5), (6, "another text of the same id", "en", "b", "x", 0.5), (None, "a row without an id", "en", "b", "x", 0.5),
    (7, "12345 !!! 678", "en", "", "x", 0.5), (8, "emoji \U0001f600 and nbsp\ttab\n\nlines", "fr", "c", "x", 0.5),
]
SCHEMA = "doc_id long, text string, lang string, source string, component_id string, score double"


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(DOCS, SCHEMA).repartition(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id > 1000")
