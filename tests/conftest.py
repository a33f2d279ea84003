import os

import pytest

from tesela.session import local_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BENCH_DRIVER_MEM", "3g")
    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
