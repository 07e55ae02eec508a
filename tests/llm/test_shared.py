import pytest
from pyspark.sql import functions as F

from fieldstream.llm.shared import labelled_sample


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, f"hot {k % 7}") for k in range(5000)] + [(2, "both"), (3, None), (4, "four"), (5, "x" * 1000), (None, "none"), (6, "six")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 1), (5, 0), (6, None), (None, 1), (7, 1)], "doc_id long, y int")


def test_one_row_for_each_id(spark, docs):
    never = F.lit(False)
    texts, y = labelled_sample(docs, labels(spark), "y", never, 10)
    assert len(texts) == 4 and sorted(zip(texts, y, strict=True), key=str) == sorted([(texts[0], 1), ("", 0), ("four", 1), ("x" * 1000, 0)], key=str)
    assert texts[0].startswith("hot ") and labelled_sample(docs.orderBy(F.desc("text")), labels(spark), "y", never, 10) == (texts, y)


def test_bounds(spark, docs):
    never = F.lit(False)
    assert len(labelled_sample(docs, labels(spark), "y", never, 1)[0]) <= 2
    texts, y = labelled_sample(docs, labels(spark), "y", never, 10, per_class_bytes=20)
    assert "x" * 1000 not in texts and sorted(y) == [0, 1, 1]
    assert labelled_sample(docs.limit(0), labels(spark), "y", never, 10) == ([], [])
    assert labelled_sample(docs, labels(spark), "y", F.lit(True), 10) == ([], [])
