import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lodestream.session import local_session, send_package

    s = local_session(cores=8, memory="6g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    send_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
