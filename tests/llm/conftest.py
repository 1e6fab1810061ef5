import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, c0 int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names used inside."""
    line = "one two three four five six seven eight nine ten eleven"
    long = "\n".join(f"{line} number {i} of a very long text ünd so weiter" for i in range(2000))
    rows = [
        (1, f"{line}\n{line} x\n{line} y\nlast", "en", "a"), (2, f"{line}\n{line} x\n{line} y\nlast", "en", "a"), (2, f"{line}\n{line} x\n{line} y\nlast", "en", "a"),
        (3, None, None, None), (None, "der die das und", "de", "b"), (None, None, None, None), (4, "", "en", "a"), (5, "", "de", "b"), (6, " \n\t ", "en", "c"),
        (7, long, "en", "b"), (8, "12 34 !!", None, "c"), (9, "é" * 5000, "de", None), (10, long.replace("number 7 ", "numero 7 "), "en", "b"),
    ]
    return spark.createDataFrame([(*r, None, "x", None, 1) for r in rows], DOCS)
