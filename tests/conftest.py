import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from flowloom.session import local_session

    session = local_session("8", "flowloom-tests")
    yield session
    from flowloom.operators.lineage import clear

    clear(session)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"
