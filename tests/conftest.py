import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from candlework.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g", name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def make_bars(spark):
    """Minute bars of one symbol from (high, low, last, volume) tuples."""

    def make(rows, name="U", start="2020-01-01 09:00:00"):
        from datetime import datetime, timedelta

        t0 = datetime.fromisoformat(start)
        data = [
            (name, t0 + timedelta(minutes=i), float(c), float(h), float(low), float(c), 1.0, float(v))
            for i, (h, low, c, v) in enumerate(rows)
        ]
        from candlework.schema import BAR_SCHEMA

        return spark.createDataFrame(data, BAR_SCHEMA)

    return make
