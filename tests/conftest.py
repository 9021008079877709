import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from sentrymill.operators import skew  # noqa: E402
from sentrymill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def all_heavy(monkeypatch):
    """Small data takes the paths that are meant for heavy keys and large tables."""
    monkeypatch.setattr(skew, "HEAVY_SHARE", 0.02)
    monkeypatch.setattr(skew, "LEAST_ROWS", 1)
