import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("TZ", "UTC")
    session = SparkSession.builder.master("local[4]").config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
