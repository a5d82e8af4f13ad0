import sys

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) rows, with columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, text, None if n % 3 else "en", None, None, "x", 7) for n, (i, text) in enumerate(rows)]
        names = (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("key", T.StringType()), ("component", T.LongType()))
        return spark.createDataFrame(full, T.StructType([T.StructField(n, t) for n, t in names]))

    return make


def pytest_configure():
    sys.setrecursionlimit(5000)
