import pytest

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text), with columns whose names operators use themselves."""

    def make(rows):
        names = "doc_id bigint, text string, component string, block string, node string, ids string, n string, label string, line string"
        return spark.createDataFrame([(d, t, *["x"] * 7) for d, t in rows], names)

    return make


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def middle():
    return MIDDLE
