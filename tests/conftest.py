import tempfile

import pytest

from proofgrid.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests")
    s.sparkContext.setLogLevel("ERROR")
    if s.conf.get("spark.checkpoint.dir", None) is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
