import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from relaymill.schema import QUEUE_RECORD, REQUEST
from relaymill.session import local_session

T0 = dt.datetime(2025, 8, 20, 10, 15, 20, 123456)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["TZ"] = "UTC"
    session = local_session(4, "6g", shared_folder=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def as_requests(spark):
    def build(rows):
        """rows: (path, body) in order of arrival"""
        data = [(i, path, body, T0) for i, (path, body) in enumerate(rows, 1)]
        return spark.createDataFrame(data, REQUEST)

    return build


@pytest.fixture
def as_records(spark):
    def build(bodies, clock=T0):
        return spark.createDataFrame([(i, 0, clock, b) for i, b in enumerate(bodies, 1)], QUEUE_RECORD)

    return build
