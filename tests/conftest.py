import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from almagest.session import local_session  # noqa: E402

SF_DIR = os.environ.get("ALMAGEST_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="almagest-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    from almagest.plans import harness
    return harness.duck(sf_dir)
