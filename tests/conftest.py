import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def risk_table(spark):
    """Build (stream_id, window_idx, risk) from a dict of risk lists."""
    def make(streams):
        rows = [(k, i, None if v is None else float(v))
                for k, vs in streams.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "stream_id string, window_idx bigint, risk double")
    return make


@pytest.fixture(scope="session")
def eps_table(spark):
    def make(eps, streams=("a",)):
        return spark.createDataFrame([(s, float(eps)) for s in streams],
                                     "stream_id string, eps double")
    return make
