import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from chainlens.session import get_session

    s = get_session("local[*]", app="chainlens-tests", conf={
        "spark.sql.shuffle.partitions": "8",
        "spark.local.dir": tempfile.mkdtemp(prefix="chainlens-test-local-"),
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="chainlens-test-")
