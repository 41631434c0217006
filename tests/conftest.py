from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stakelens.session import build_session  # noqa: E402

TESTDATA = os.environ.get("STAKELENS_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    checkpoints = tmp_path_factory.mktemp("checkpoints")
    session = build_session(
        "tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(checkpoints),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("tables")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
