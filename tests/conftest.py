import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from quarry.session import drop_written, local_session

    session = local_session("8", shuffle_partitions=4, memory="12g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_written(session)
    session.stop()
