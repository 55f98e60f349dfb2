import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from siftlog.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def text(spark):
    """One-column table of entry texts."""

    def make(*contents):
        rows = [("f.log", i + 1, i + 1, c) for i, c in enumerate(contents)]
        return spark.createDataFrame(rows, "file_path string, start_line bigint, end_line bigint, content string")

    return make
