import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import database, session  # noqa: E402
from leadloom.plans.session import tune  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return tune(session("4"))


@pytest.fixture(scope="session")
def duck():
    return database(SF_DIR)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
