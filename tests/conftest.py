from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sitelens.session import get_session

    session = get_session(cores=4, shuffle_partitions=4, memory="4g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
