import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellset.session import build_session  # noqa: E402
from cellset.sources.surrogates import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    return Tables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def medium(spark):
    return Tables(spark, "/root/testdata/sf0.01")
