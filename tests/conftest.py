import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidegrid.session import local_session

    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tiny_pieces(monkeypatch):
    """Cut every series into pieces of a few rows."""
    from tidegrid.operators import scan

    monkeypatch.setattr(scan, "SEGMENT_ROWS", 7)
