import pytest

from .test_operators import AWKWARD


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "TEXT column", "x", 3, "f0") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, key string, n_tokens int, node string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
