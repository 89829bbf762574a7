import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewarden.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tablewarden-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def wide(monkeypatch):
    """Treat every group as too large for one task and every summary as too large to broadcast."""
    from tablewarden.operators import joins, ordered, outlier

    monkeypatch.setattr(ordered, "GROUP_LIMIT", 0)
    monkeypatch.setattr(joins, "GROUP_LIMIT", 0)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 3)
    monkeypatch.setattr(outlier, "HOT_VALUES", 0)
