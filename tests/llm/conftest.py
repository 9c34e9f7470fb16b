import tempfile

import pytest
from pyspark.sql import SparkSession

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    if SparkSession.getActiveSession() is None:
        SparkSession.builder.config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tillweave-test-"))
    return local_session()


#: Nulls, empty and blank texts, ties, a repeated row, a long text, and columns whose names the operators use themselves.
ROWS = [
    (1, "the cat sat on the mat and the dog lay by the door of the house", "en", "a"),
    (2, "the cat sat on the mat and the dog lay by the door of the house", "en", "a"),
    (3, "", "en", "a"),
    (4, None, "en", "b"),
    (5, " \t\n ", None, None),
    (6, "12 34 !?", "de", "b"),
    (7, "un chat noir dort sur le lit de la maison et le chien aussi", "fr", "b"),
    (7, "un chat noir dort sur le lit de la maison et le chien aussi", "fr", "b"),
    (8, "word " * 5000 + "İstanbul 中文 😀", "en", None),
    (None, "a text without an id  \n\n twice", "en", "a"),
    (9, "x", None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size int, target double, part string, epochs int, row string, likeness double, score int, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, 7, 1.5, "p", 9, "r", 0.1, 3, "k") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
