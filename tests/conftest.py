import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """A one-column table with a row number as key."""
    def make(name, values):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {name} double")
    return make


@pytest.fixture
def visits(spark):
    rows = [("S1", 1, 72.0, 120.0, 80.0), ("S1", 2, 75.0, 118.0, 78.0), ("S1", 3, 71.0, 122.0, 82.0),
            ("S2", 1, 68.0, 130.0, 85.0), ("S2", 2, 240.0, 128.0, 84.0)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "id long, subject_id string, visit int, heart_rate double, systolic_bp double, "
                                 "diastolic_bp double")
