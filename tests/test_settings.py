"""Settings that change: which changes end an era, and what an era forgets."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from millwatch.operators.settings import settings_eras
from millwatch.plans.monitor import Settings, control_history, monitor, monitor_history
from tests.conftest import CONFIG_SCHEMA, EPOCH, at, config_row, config_table, readings_table, tick

HISTORY = "valid_from timestamp, " + CONFIG_SCHEMA


def history(spark, *rows):
    """Rows of (seconds or None, config row)."""
    return spark.createDataFrame([(None if s is None else at(s), *row) for s, row in rows], HISTORY)


def log(spark, *rows):
    return spark.createDataFrame([(m, at(t), c, i) for i, (m, t, c) in enumerate(rows)], "equipment_id string, ts timestamp, command string, ord bigint")


def plant(seed=3, seconds=120, tags="ab"):
    rng = random.Random(seed)
    return [("m1", t, s, rng.random()) for s in range(seconds) for t in tags]


def spans(df):
    rel = lambda t: None if t is None else t - tick(0)
    return [(r["era"], r["state"], rel(r["valid_from"]), rel(r["valid_to"]), r["cause"]) for r in df.orderBy("era", F.col("valid_from").asc_nulls_first()).collect()]


COMMANDS = [("m1", 40, "train"), ("m1", 100, "train")]


@pytest.mark.parametrize(
    "later,cause",
    [(config_row(tags=("a", "c")), "tags differ"), (config_row(tags=("a",)), "tags differ"), (config_row(window=5), "window_size differs"),
     (config_row(interval=500), "resample_interval_ms differs")],
)
def test_a_breaking_change_sends_the_machine_back(spark, later, cause):
    changes = history(spark, (None, config_row()), (60.5, later))
    got = spans(control_history(readings_table(spark, plant(tags="abc")), log(spark, *COMMANDS), changes, Settings()))
    assert got[:2] == [(0, "CALIBRATING", None, 40, None), (0, "MONITORING", 40, 61, None)]
    if cause.startswith("resample"):
        assert [g[:2] for g in got[2:]] == [(1, "CALIBRATING"), (1, "MONITORING")] and got[2][4] == cause
    else:
        assert got[2:] == [(1, "CALIBRATING", 61, 100, cause), (1, "MONITORING", 100, None, None)]


def test_a_change_that_breaks_nothing_keeps_the_model(spark):
    rows, commands = readings_table(spark, plant()), log(spark, *COMMANDS)
    changes = history(spark, (None, config_row()), (60, config_row(tags=("b", "a"), min_samples=7, keep="1d")), (70, config_row(tags=("b", "a"))))
    assert spans(control_history(rows, commands, changes, Settings())) == [(0, "CALIBRATING", None, 40, None), (0, "MONITORING", 40, None, None)]
    got = monitor_history(rows, commands, changes, Settings()).select("tick", "anomaly_score", "alarm").orderBy("tick").toPandas()
    want = monitor(rows, commands, config_table(spark, config_row(tags=("b", "a"))), Settings()).orderBy("tick").toPandas()
    assert got.tick.tolist() == want.tick.tolist() and abs(got.anomaly_score - want.anomaly_score).max() < 1e-12


def test_a_new_era_scores_nothing_until_it_is_trained(spark):
    """Values, windows and samples of the era before are gone; a train uses those of its own."""
    changes = history(spark, (None, config_row()), (60, config_row(tags=("a", "c"))))
    rows = plant() + [("m1", "c", s, float(s % 7)) for s in range(80, 120)]
    scores = monitor_history(readings_table(spark, rows), log(spark, *COMMANDS), changes, Settings()).toPandas()
    ticks = {era: sorted(part.tick - tick(0)) for era, part in scores.groupby("era")}
    assert ticks == {0: list(range(40, 60)), 1: list(range(100, 120))}
    early = monitor_history(readings_table(spark, rows), log(spark, ("m1", 40, "train"), ("m1", 70, "train")), changes, Settings())
    assert early.filter("era = 1").isEmpty()


def test_sample_counts_hold_from_their_time(spark):
    changes = history(spark, (None, config_row(min_samples=1000)), (60, config_row(min_samples=5)))
    assert spans(control_history(readings_table(spark, plant()), log(spark, *COMMANDS), changes, Settings())) == [
        (0, "CALIBRATING", None, 100, None), (0, "MONITORING", 100, None, None)
    ]


def test_versions_of_one_start_and_late_machines(spark):
    changes = history(spark, (5, config_row(window=3)), (5, config_row(window=4)), (None, config_row("m2")), (9, config_row("m2", window=2)))
    eras = {(r["equipment_id"], r["era"]): r for r in settings_eras(changes).collect()}
    assert len(eras) == 2 and eras["m1", 0]["window_size"] == 4 and eras["m2", 0]["cause"] is None
    assert eras["m1", 0]["from_us"] == int((EPOCH + timedelta(seconds=4)).timestamp() * 1e6)
    got = control_history(readings_table(spark, plant(seconds=20)), log(spark), changes, Settings())
    assert {(r["equipment_id"], r["valid_from"]) for r in got.collect()} == {("m1", tick(5)), ("m2", None)}
