import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventflow.session import build_session, use_rocksdb_state  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("eventflow-tests", "local[8]", 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    use_rocksdb_state(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
