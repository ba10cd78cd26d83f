import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""

    def of(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows], DOCUMENTS)

    return of


#: Names that operators use inside; an input may have them too.
CLASHING = ("key", "n", "rank", "share", "length", "start", "sha256", "bands", "node", "component", "class_id", "least", "anchors", "places", "word", "bit", "label", "score", "spans", "edge", "path", "file_id", "item_id", "own", "before", "kept_number")


@pytest.fixture(scope="session")
def nasty(spark, make):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and looked at the door for a while."),
        (1, "The cat sat on the mat and looked at the door for a while."),
        (2, ""),
        (3, None),
        (None, "A text without an id, with password: hunter2secret and a@b.example.org in it."),
        (None, None),
        (4, long_text),
        (5, long_text + " tail"),
        (6, "  \n\t "),
        (7, "!!! ??? 123"),
        (8, "The cat sat on the mat and looked at the door for a while."),
        (1, "Another text with the same id."),
        (9, "  \U0001f600 é́ \x00 token = 'abcdef' 中文"),
    ]
    docs = make(rows)
    docs = docs.withColumn("lang", F.when(F.col("doc_id").isin(2, 4), None).otherwise(F.col("lang")))
    return docs.withColumns({name: F.lit(i) for i, name in enumerate(CLASHING)})


@pytest.fixture(scope="session")
def empty(make):
    return make([(1, "x")]).where("doc_id is null")
