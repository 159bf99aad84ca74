import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    from sitefold.runtime import ship_package

    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def mr(spark):
    from sitefold.plans import fixtures as fx

    return fx.mr_rows(spark, SF).checkpoint()


@pytest.fixture(scope="session")
def pdf(mr):
    return mr.toPandas()
