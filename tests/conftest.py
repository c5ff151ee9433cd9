import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskweave.session import local_session
    s = local_session("*", shuffle_partitions=8, app_name="riskweave-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
