"""One local session for all tests; each test's tables are small and whole."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sylva.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("local[8]", partitions=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
