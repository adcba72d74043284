import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tidemark-tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false",
                            spark_driver_memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("a int, b string", (1, "x"), ...)"""
    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make


@pytest.fixture
def points(frame):
    """Event frame (stay_id, hours, value)."""
    def make(*rows):
        return frame("stay_id long, hours double, value double", *rows)

    return make


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
