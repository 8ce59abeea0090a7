import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import tempfile  # noqa: E402

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tests",
        **{"spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "6g", "spark__ui__showConsoleProgress": "false", "spark__checkpoint__dir": "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
