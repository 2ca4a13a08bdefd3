import random

import pytest
from pyspark.sql import functions as F

from millwatch.operators.snapshots import (
    asof_snapshot,
    number_snapshots,
    recent_n,
    sliding_windows,
    with_window_state,
)
from tests.conftest import config_row, config_table, readings_table, tick


def rows_of(df):
    return {(r["equipment_id"], r["tick"] - tick(0)): list(r["values"]) for r in df.collect()}


def test_value_is_held_and_unseen_tag_is_null(spark):
    readings = readings_table(spark, [("m1", "a", 1, 5.0), ("m1", "b", 4, 7.0), ("m1", "other", 3, 9.0)])
    got = rows_of(asof_snapshot(readings, config_table(spark)))
    assert got == {("m1", 1): [5.0, None], ("m1", 2): [5.0, None], ("m1", 3): [5.0, None], ("m1", 4): [5.0, 7.0]}


def test_explicit_null_overwrites_and_empty_ticks_vanish(spark):
    readings = readings_table(spark, [("m1", "a", 1, 5.0), ("m1", "a", 2, None), ("m1", "a", 5, 6.0)])
    config = config_table(spark, config_row(tags=("a",)))
    assert rows_of(asof_snapshot(readings, config)) == {("m1", 1): [5.0], ("m1", 5): [6.0]}
    assert rows_of(asof_snapshot(readings, config, keep_empty=True))[("m1", 3)] == [None]


def test_latest_reading_of_a_tick_wins_and_nan_is_missing(spark):
    readings = readings_table(
        spark, [("m1", "a", 0.5, 1.0), ("m1", "a", 0.9, 2.0), ("m1", "a", 0.9, 3.0), ("m1", "b", 1, float("nan"))]
    )
    assert rows_of(asof_snapshot(readings, config_table(spark))) == {("m1", 1): [3.0, None]}


def test_grid_goes_on_without_readings(spark):
    readings = readings_table(spark, [("m1", "a", 1, 5.0)])
    got = rows_of(asof_snapshot(readings, config_table(spark), size=4, until=F.lit(tick(12))))
    assert sorted(k for _, k in got) == list(range(1, 13))


def machine_rows(rng, equipment, tags, ticks, share_null=0.15):
    rows = []
    for t in range(ticks):
        for tag in tags:
            if rng.random() < 0.3:
                rows.append((equipment, tag, t, None if rng.random() < share_null else float(rng.randint(0, 9))))
    return rows


def replay(rows, tags, ticks):
    """Snapshots by walking through time with a dictionary."""
    latest, out, by_tick = {}, [], {}
    for _, tag, t, v in rows:
        by_tick.setdefault(t, []).append((tag, v))
    last = max(by_tick)
    for t in range(min(by_tick), last + 1):
        latest.update(by_tick.get(t, []))
        values = [latest.get(tag) for tag in tags]
        if any(v is not None for v in values):
            out.append((t, values))
    return out


# A bucket of three is shorter than the longest window.
@pytest.mark.parametrize("size", [3, 16, 4096])
def test_buckets_do_not_change_snapshots_or_windows(spark, size):
    rng = random.Random(5)
    plants = {"m1": (("a", "b"), 2), "m2": (("c",), 5), "m3": (("a", "b", "c"), 3)}
    rows = [r for m, (tags, _) in plants.items() for r in machine_rows(rng, m, tags, 150)]
    # One machine with a long silence that spans many small buckets.
    rows += [("m1", "a", 900, 1.0)]
    config = config_table(spark, *[config_row(m, tags, window=w) for m, (tags, w) in plants.items()])
    numbered = number_snapshots(asof_snapshot(readings_table(spark, rows), config, size), size)
    states = {
        (r["equipment_id"], r["tick"] - tick(0)): r for r in with_window_state(numbered, config, size).collect()
    }
    windows = {
        (r["equipment_id"], r["tick"] - tick(0)): (r["history"], r["target"])
        for r in sliding_windows(numbered, config, size).collect()
    }
    seen = 0
    for m, (tags, w) in plants.items():
        shots = replay([r for r in rows if r[0] == m], tags, 150)
        for i, (t, values) in enumerate(shots):
            got = states[(m, t)]
            assert list(got["values"]) == values and got["seq"] == i
            assert got["prev"] == (shots[i - 1][1] if i else None)
            full = i >= w and all(v is not None for _, vs in shots[i - w : i + 1] for v in vs)
            assert got["usable"] == full
            assert ((m, t) in windows) == full
            if full:
                seen += 1
                assert windows[(m, t)] == ([vs for _, vs in shots[i - w : i]], values)
        assert sum(k[0] == m for k in states) == len(shots)
    assert seen > 50


def test_window_examples(spark):
    config = config_table(spark, config_row(window=2))
    rows = [("m1", t, i, float(v)) for i in range(5) for t, v in (("a", i), ("b", 10 * i))]
    numbered = number_snapshots(asof_snapshot(readings_table(spark, rows), config))
    got = sliding_windows(numbered, config).orderBy("tick").collect()
    assert [(r["history"], r["target"]) for r in got] == [
        ([[0, 0], [1, 10]], [2, 20]),
        ([[1, 10], [2, 20]], [3, 30]),
        ([[2, 20], [3, 30]], [4, 40]),
    ]


@pytest.mark.parametrize("values", [[1, None, 3, 4], [1, 2, None], [1]])
def test_no_window_over_a_missing_value_or_too_few_rows(spark, values):
    config = config_table(spark, config_row(tags=("a", "b"), window=2))
    rows = [("m1", "b", i, 1.0) for i in range(len(values))] + [("m1", "a", i, v and float(v)) for i, v in enumerate(values)]
    numbered = number_snapshots(asof_snapshot(readings_table(spark, rows), config))
    assert sliding_windows(numbered, config).count() == 0


@pytest.mark.parametrize("size", [3, 10, 4096])
def test_recent_n(spark, size):
    rows = [("m1", "a", 2 * i, 1.0) for i in range(30)] + [("m2", "a", 0, 1.0), ("m2", "a", 3, 1.0)]
    config = config_table(spark, config_row("m1"), config_row("m2"))
    got = recent_n(asof_snapshot(readings_table(spark, rows), config, size), 11, size)
    by = {}
    for r in got.collect():
        by.setdefault(r["equipment_id"], []).append(r["tick"] - tick(0))
    assert sorted(by["m1"]) == list(range(48, 59)) and sorted(by["m2"]) == [0, 1, 2, 3]
