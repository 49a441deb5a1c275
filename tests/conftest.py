from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from risklattice.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(os.environ.get("TEST_CPUS", "8"), "tests")
    yield session
    session.stop()
