import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from scorelake import engine_session

    base = tempfile.mkdtemp(prefix="scorelake-tests-")
    session = engine_session("tests", **{
        "spark.master": os.environ.get("TEST_MASTER", "local[8]"), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.checkpoint.dir": base,
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def make(spark):
    """Small DataFrames from rows and a DDL schema."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)
