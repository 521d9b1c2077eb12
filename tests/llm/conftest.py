import pytest

SF = "/root/testdata/sf0.001"


def edge_rows():
    long = "Un mot après l'autre, and then another. " * 4000
    return [
        (1, "plain words in a row, nothing else", "en", "a", 34),
        (2, None, "en", None, None),
        (3, "", None, "a", 0),
        (4, " \n\t ", "fr", "a", 4),
        (5, long, "en", "a", len(long)),
        (6, "plain words in a row, nothing else", "en", "b", 34),
        (6, "plain words in a row, nothing else", "en", "b", 34),
        (7, "É\u0301 ß ﬀ 漢字 \U0001f600 \x1c\u2028 </s>", "de", "a", 20),
        (None, "no id at all but some words", "en", "a", 5),
        (8, "12345 !!! ???", None, "a", 13),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, an empty, a blank and a long text, ties, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("fp", "piece", "score", "label", "y", "head", "own", "part", "fingerprint", "component_id", "root", "node", "ids", "x", "length", "start")
    return rows.withColumns({c: F.lit("clash") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
