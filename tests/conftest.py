import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session, shared_dir
    s = build_session(cpus="*", shuffle_partitions=8, driver_memory="8g")
    shared_dir(s)
    yield s
    s.stop()
