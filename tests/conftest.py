import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadlog import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    spark = session.build("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(params=["plain", "split"])
def mode(request, spark):
    """Every test with this fixture runs with plain windows and with hot entities cut into tiny chunks."""
    names = {"spark.roadlog.chunkRows": "7", "spark.roadlog.buckets": "3"}
    if request.param == "split":
        for name, value in names.items():
            spark.conf.set(name, value)
    yield request.param
    for name in names:
        spark.conf.unset(name)
