import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from gridloom.session import clear_scratch, get_session

    session = get_session("tests", cores=4, spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="gridloom-tests-"))
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
