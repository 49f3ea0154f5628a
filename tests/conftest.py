"""One small local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    return build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
