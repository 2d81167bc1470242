import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_corpus import SCHEMA, corpus  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with extra columns named like what operators make."""
    from pyspark.sql import functions as F

    names = ["digest", "sig", "n", "h", "block", "source_", "copies", "keep", "row", "rank", "uid", "node", "root", "_x", "u", "v", "start", "_drop", "_hit", "_mix_id", "_mix_source", "mix_copies", "label", "quality"]
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
