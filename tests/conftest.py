from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from eventstrand.session import configure

    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


EVENT_SCHEMA = (
    "user_id bigint, timestamp_event timestamp_ntz, event_id bigint, value double, event_type int, "
    "product_id bigint"
)


@pytest.fixture(scope="session")
def events_of(spark):
    """(user, second, value, type, product) tuples -> raw events, numbered in the given order."""
    from datetime import datetime, timedelta

    def build(rows):
        start = datetime(2024, 1, 1)
        return spark.createDataFrame(
            [
                (user, start + timedelta(seconds=second), i, value, kind, product)
                for i, (user, second, value, kind, product) in enumerate(rows)
            ],
            EVENT_SCHEMA,
        )

    return build


@pytest.fixture
def short_segments(monkeypatch):
    """Let segments be as short as the tests ask for."""
    monkeypatch.setattr("eventstrand.operators.histories.MIN_SEGMENT_EVENTS", 1)


@pytest.fixture(scope="session")
def plan_of():
    """The physical plan as ``explain`` prints it."""
    from contextlib import redirect_stdout
    from io import StringIO

    def plan(df) -> str:
        text = StringIO()
        with redirect_stdout(text):
            df.explain()
        return text.getvalue()

    return plan
