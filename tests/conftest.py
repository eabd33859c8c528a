import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seamline.session import local_session, tuned  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tuned(local_session("8", "tests"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
