import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="corpusloom-test-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    def make(files: dict[str, str]):
        rows = [(p, len(c.encode()), c) for p, c in files.items()]
        return spark.createDataFrame(rows, "path string, size_bytes bigint, content string")

    return make


HARBOUR = """import math

class HarbourController:
    def berth_for(self, length):
        if length > 90:
            return "outer"
        return "inner"

    def tide(self, hour):
        return math.sin(hour / 2)
"""
PUMP = """fun start(level: Int): Boolean {
    while (level < 3) { drain() }
    return true
}
"""


@pytest.fixture
def small_tree():
    return {
        "port/harbour_controller.py": HARBOUR,
        "src/main/kotlin/port/water/Pump.kt": PUMP,
    }
