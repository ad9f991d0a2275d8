import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailsift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("MAILSIFT_CORES", "8"))
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def one(spark):
    """Evaluates columns over a single row."""

    def run(*columns, **values):
        frame = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["_"])
        row = frame.select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run
