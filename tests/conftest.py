import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from codeloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def docs(spark):
    """Documents from ``path -> content``."""

    def make(contents: dict[str, str], repo: str = "r"):
        rows = [(repo, path, content) for path, content in contents.items()]
        return spark.createDataFrame(rows, "repo string, path string, content string")

    return make
