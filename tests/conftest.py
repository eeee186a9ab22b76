import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="assay-tests-"))
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def gauges(spark):
    rows = [(i, 40 + 3 * (i * 7 % 10), i * 0.75, 1.25 + 0.5 * (i * 3 % 10)) for i in range(10)]
    return spark.createDataFrame(rows, "site_id long, wind long, rain_mm double, level double")


@pytest.fixture
def plots(spark):
    rows = [
        (0, None, "clay", 7),
        (1, 2.5, "sand", 11),
        (2, 8.5, None, 3),
        (3, None, "sand", 15),
        (4, 4.5, "clay", 19),
        (5, 6.5, "loam", 23),
    ]
    return spark.createDataFrame(rows, "plot_id long, depth_m double, soil string, harvest long")
