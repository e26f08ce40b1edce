import pytest

from docmatch import configure
from workloads.check import oracle, session


@pytest.fixture(scope="session")
def spark():
    spark = configure(session(4))
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def db():
    return oracle("/root/testdata/sf0.001")
