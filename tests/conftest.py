import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="session")
def as_rows():
    return rows


@pytest.fixture(scope="session")
def make_log(spark):
    """Log from (event_id, case_id, seconds, activity[, cluster]) tuples; seconds may be None."""
    import datetime

    start = datetime.datetime(2024, 1, 1)

    def build(events):
        data = [
            (
                e[0], e[1], None if e[2] is None else start + datetime.timedelta(seconds=e[2]), e[3],
                e[4] if len(e) > 4 else e[1],
            )
            for e in events
        ]
        return spark.createDataFrame(data, "event_id long, case_id string, ts timestamp_ntz, activity string, cluster string")

    return build


@pytest.fixture(scope="session")
def make_graph(spark):
    """Vertices and counted edges from a name string and (src, dst, cnt) tuples."""

    def build(names, edges):
        nodes = spark.createDataFrame([(n,) for n in names], "activity string")
        return nodes, spark.createDataFrame([(s, d, c) for s, d, c in edges], "src string, dst string, cnt long")

    return build
