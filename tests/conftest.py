import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from logloom.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("logloom-tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture
def events(spark):
    """Four log lines over three days, all text."""
    from logloom.functions.columns import annotate

    rows = [
        (1, 1, "2024-01-05 10:00:00", "4624", "alice", r"C:\Windows\svchost.exe"),
        (1, 2, "2024-01-05 11:30:00", "4688", "Bob Smith", r"C:\Temp\evil.exe"),
        (1, 3, "2024-01-06 09:00:00", "N/A", "ALICE", "powershell -enc AAAA"),
        (1, 4, "1/7/2024 8:00 PM", "", None, ""),
    ]
    df = spark.createDataFrame(
        rows, "source_id int, rid bigint, Timestamp string, EventId string, User string, Cmd string"
    )
    return annotate(df, {"Timestamp": "datetime", "EventId": "number"})


@pytest.fixture
def rids():
    return lambda df: sorted(r["rid"] for r in df.select("rid").collect())
