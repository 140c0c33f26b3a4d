import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from hirelake.session import build_session  # noqa: E402
from hirelake.sources.standins import Stage  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[8]", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
                                     "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
                                     "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def stage(spark):
    return Stage(spark, SF)


@pytest.fixture
def in_parts(spark):
    """Small shuffles keep their partitions, so that code for many pieces meets many."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)
