from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millwatch.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EPOCH = datetime(2026, 8, 3, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(seconds: float) -> datetime:
    return EPOCH + timedelta(seconds=seconds)


CONFIG_SCHEMA = (
    "equipment_id string, subscribe_topics array<string>, publish_topic string, command_topic string, "
    "tags array<string>, resample_interval_ms int, window_size int, max_duration string, min_samples int"
)
READING_SCHEMA = "equipment_id string, tag string, ts timestamp, value double, ord bigint"


def config_row(equipment="m1", tags=("a", "b"), interval=1000, window=2, keep="7d", min_samples=1):
    return (equipment, [f"in/{equipment}"], f"out/{equipment}", f"cmd/{equipment}", list(tags), interval, window, keep, min_samples)


def config_table(spark, *rows):
    return spark.createDataFrame(list(rows) or [config_row()], CONFIG_SCHEMA)


def readings_table(spark, rows):
    """Rows of (equipment, tag, seconds, value); arrival follows list order."""
    full = [(e, t, at(s), v, i) for i, (e, t, s, v) in enumerate(rows)]
    return spark.createDataFrame(full, READING_SCHEMA)


def tick(seconds: int, interval_ms: int = 1000) -> int:
    """Tick number of a whole number of seconds after the test epoch."""
    return int(EPOCH.timestamp() * 1000) // interval_ms + seconds * 1000 // interval_ms
