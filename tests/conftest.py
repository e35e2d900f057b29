import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", "8g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_limits(monkeypatch):
    """Make ordinary test tables count as skewed, so that the long plans run."""
    from ledgerlens.functions import skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 5)
    monkeypatch.setattr(skew, "HEAVY_KEYS", 3)
    monkeypatch.setattr(skew, "SAMPLE", 6)
    monkeypatch.setattr(skew, "CHUNKS", 4)
    monkeypatch.setattr(skew, "BLOCK", 3)
