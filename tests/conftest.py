import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from splicelake.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    yield s
    s.stop()
