import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from carelens.session import local_session
    s = local_session("4", shuffle_partitions=4, app="carelens-tests")
    yield s
    s.stop()
