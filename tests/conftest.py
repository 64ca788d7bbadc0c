import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pitbars.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "pitbars-tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
