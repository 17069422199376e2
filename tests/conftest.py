import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from engramlake.session import get_spark

    s = get_spark("tests", 4, spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-tests-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
