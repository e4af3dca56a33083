import pytest
from lending import VISITS, filled
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def library(spark, tmp_path_factory):
    """Read only; the visits of one member are sealed, the other's open."""
    ses = filled(spark, tmp_path_factory.mktemp("library"), segment_points=30)
    ses["Member"].append_series("visits", 100, VISITS[100])
    ses.flush()
    ses["Member"].append_series("visits", 103, VISITS[103])
    return ses
