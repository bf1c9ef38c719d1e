"""One local session for all tests."""

from __future__ import annotations

import pytest

from lodestone.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
