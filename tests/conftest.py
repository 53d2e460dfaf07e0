import os

import pytest

from marlstone.session import local_session

DATA = os.environ.get("MARLSTONE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "marlstone-tests")
    yield session


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA
