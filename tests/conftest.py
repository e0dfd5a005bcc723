import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tillscope.session import get_spark
    s = get_spark(4, shuffle_partitions=4, app="tillscope-tests", driver_memory="4g")
    yield s
    s.stop()
