import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millwatch.operators.control import (
    control_intervals,
    model_compat,
    resume_or_fallback,
    state_asof,
    state_table,
    train_attempts,
    train_gate,
    unseen_tags,
)
from millwatch.operators.snapshots import asof_snapshot, number_snapshots, with_window_state
from millwatch.session import stage
from millwatch.sources import calibration
from tests.conftest import at, config_row, config_table, readings_table, tick
from tests.test_snapshots import machine_rows, replay

COMMANDS = "equipment_id string, ts timestamp, command string, ord bigint"


def intervals(spark, readings, commands, config, size=4096, max_training=None):
    numbered = number_snapshots(asof_snapshot(readings_table(spark, readings), config, size), size)
    rows = stage(with_window_state(numbered, config, size), "rows")
    log = spark.createDataFrame([(m, at(t), c, i) for i, (m, t, c) in enumerate(commands)], COMMANDS)
    attempts = train_attempts(rows, log, config, max_training, size)
    return rows, attempts, control_intervals(attempts, log, config)


def shifted(rows):
    zero = tick(0)
    return [
        (r["state"], r["valid_from"] and r["valid_from"] - zero, r["valid_to"] and r["valid_to"] - zero)
        for r in sorted(rows.collect(), key=lambda r: (r["equipment_id"], r["valid_from"] or -1))
    ]


BOTH = [("m1", t, i, float(i + 1)) for i in range(10) for t in "ab"]


def test_too_few_samples_is_rejected(spark):
    config = config_table(spark, config_row(min_samples=5))
    _, attempts, spans = intervals(spark, BOTH, [("m1", 3, "train")], config)
    assert attempts.first()["reason"] == "too few samples" and attempts.first()["n_samples"] == 3
    assert shifted(spans) == [("CALIBRATING", None, None)]


def test_train_then_second_train_then_recalibrate(spark):
    config = config_table(spark, config_row(min_samples=2))
    log = [("m1", 4, "train"), ("m1", 5, "train"), ("m1", 7, "recalibrate")]
    _, _, spans = intervals(spark, BOTH, log, config)
    assert shifted(spans) == [("CALIBRATING", None, 4), ("MONITORING", 4, 7), ("CALIBRATING", 7, None)]


def test_train_without_a_full_window_fails_and_the_next_one_succeeds(spark):
    config = config_table(spark, config_row(min_samples=1, window=2))
    late_b = [("m1", "a", 0, 1.0), ("m1", "b", 5, 1.0), ("m1", "a", 12, 2.0)]
    _, attempts, spans = intervals(spark, late_b, [("m1", 6, "train"), ("m1", 9, "train")], config)
    reasons = {r["tick"] - tick(0): r["reason"] for r in attempts.collect()}
    assert reasons == {6: "no full window to train on", 9: None}
    assert shifted(spans) == [("CALIBRATING", None, 9), ("MONITORING", 9, None)]


def test_train_sees_retained_samples_only(spark):
    config = config_table(spark, config_row(min_samples=5, keep="3s"))
    _, attempts, _ = intervals(spark, BOTH, [("m1", 9, "train")], config)
    assert attempts.first()["n_samples"] == 3
    config = config_table(spark, config_row(min_samples=5))
    _, attempts, _ = intervals(spark, BOTH, [("m1", 9, "train")], config, max_training=4)
    assert (attempts.first()["fit_lo"], attempts.first()["fit_hi"], attempts.first()["n_samples"]) == (5, 9, 9)


def test_train_and_recalibrate_in_one_tick(spark):
    config = config_table(spark, config_row(min_samples=1))
    _, _, spans = intervals(spark, BOTH, [("m1", 4.2, "train"), ("m1", 4.5, "recalibrate"), ("m1", 4.7, "train")], config)
    assert shifted(spans) == [("CALIBRATING", None, 5), ("CALIBRATING", 5, None)]


def machine(rows, commands, tags, window, min_samples, keep, max_training):
    """The state machine, one event at a time."""
    events = [(t, 1, i, s) for i, (t, s) in enumerate(rows)] + [(t, 0, i, c) for i, (t, c) in enumerate(commands)]
    state, samples, out = "CALIBRATING", [], {}
    for t, kind, _, what in sorted(events, key=lambda e: e[:3]):
        if kind == 1:
            out[t] = state
            if state == "CALIBRATING":
                samples.append((t, what))
        elif what == "recalibrate":
            state, samples = "CALIBRATING", []
        elif state == "CALIBRATING":
            held = [s for s in samples if s[0] >= t - keep]
            used = held[-max_training:]
            windows = any(
                all(v is not None for _, vs in used[i - window : i + 1] for v in vs) for i in range(window, len(used))
            )
            if len(held) >= min_samples and windows:
                state, samples = "MONITORING", []
    return out


@pytest.mark.parametrize("size", [16, 50, 4096])
def test_intervals_equal_the_state_machine(spark, size):
    rng = random.Random(9)
    tags, names = ("a", "b"), [f"m{i}" for i in range(6)]
    readings, commands = [], []
    for m in names:
        readings += machine_rows(rng, m, tags, 200, share_null=0.1)
        commands += [(m, t, rng.choice(["train", "train", "train", "recalibrate"])) for t in sorted(rng.sample(range(205), 18))]
    config = config_table(spark, *[config_row(m, tags, window=3, keep="40s", min_samples=12) for m in names])
    rows, _, spans = intervals(spark, readings, commands, config, size, max_training=20)
    got = {
        (r["equipment_id"], r["tick"] - tick(0)): r["state"] for r in state_asof(rows.select("equipment_id", "tick"), spans, size).collect()
    }
    seen = set()
    for m in names:
        shots = replay([r for r in readings if r[0] == m], tags, 200)
        want = machine(shots, [(t, c) for e, t, c in commands if e == m], tags, 3, 12, 40, 20)
        assert {t: s for (e, t), s in got.items() if e == m} == want
        seen |= set(want.values())
    assert seen == {"CALIBRATING", "MONITORING"}


def test_state_table_and_gate(spark):
    config = config_table(spark, config_row("m1", min_samples=3), config_row("m2", min_samples=4), config_row("m3"))
    stored = spark.createDataFrame([("m1", "MONITORING"), ("m2", "??")], "equipment_id string, state string")
    got = dict(map(tuple, state_table(stored, config).collect()))
    assert got == {"m1": "MONITORING", "m2": "CALIBRATING", "m3": "CALIBRATING"}
    counts = spark.createDataFrame([("m1", 3), ("m2", 3)], "equipment_id string, n_samples long")
    assert {r["equipment_id"]: r["allowed"] for r in train_gate(counts, config).collect()} == {"m1": True, "m2": False}


def test_models_that_do_not_fit_the_settings(spark):
    config = config_table(spark, *[config_row(m) for m in ("m1", "m2", "m3", "m4")])
    models = spark.createDataFrame(
        [("m1", 1, 9, ["a", "b"]), ("m1", 2, 2, ["b", "a"]), ("m2", 1, 3, ["a", "b"]), ("m3", 1, 2, ["a"])],
        "equipment_id string, model_version bigint, window_size int, tags array<string>",
    )
    ok = {(r["equipment_id"], r["model_version"]): r["reason"] for r in model_compat(models, config).collect()}
    assert ok == {("m1", 1): "window_size differs", ("m1", 2): None, ("m2", 1): "window_size differs", ("m3", 1): "tags differ"}
    stored = config.select("equipment_id", F.lit("MONITORING").alias("state"))
    got = {r["equipment_id"]: (r["state"], r["model_version"], r["reason"]) for r in resume_or_fallback(stored, models, config).collect()}
    assert got == {
        "m1": ("MONITORING", 2, None),
        "m2": ("CALIBRATING", None, "window_size differs"),
        "m3": ("CALIBRATING", None, "tags differ"),
        "m4": ("CALIBRATING", None, "no stored model"),
    }


def test_sample_store(spark, tmp_path):
    config = config_table(spark, config_row(tags=("a",), keep="5s"))
    rows, _, spans = intervals(
        spark, [("m1", "a", i, None if i == 3 else float(i)) for i in range(10)], [("m1", 6, "recalibrate")],
        config_table(spark, config_row(tags=("a",), window=2)),
    )
    samples = calibration.calibration_samples(state_asof(rows, spans), config)
    calibration.calibration_append(samples, str(tmp_path / "s"))
    stored = calibration.calibration_table(spark, str(tmp_path / "s"))
    assert calibration.calibration_count(stored).first()["n_samples"] == 9
    now = spark.createDataFrame([("m1", at(9))], "equipment_id string, now timestamp")
    kept = calibration.calibration_prune(stored, config, now)
    assert sorted(r["tick"] - tick(0) for r in kept.collect()) == [4, 5, 6, 7, 8, 9]
    left = calibration.calibration_clear(stored, spans)
    assert sorted(r["tick"] - tick(0) for r in left.collect()) == [6, 7, 8, 9]


def test_prune_reads_border_days_only(spark, tmp_path):
    """Files of days without a cutoff are removed or left as they are; only the border day is written again."""
    path = str(tmp_path / "s")
    day = 86400
    samples = spark.range(6 * 24).select(
        F.lit("m1").alias("equipment_id"), F.lit(0).cast("long").alias("episode"), F.col("id").alias("tick"),
        F.timestamp_seconds(F.lit(10 * day) + F.col("id") * 3600).alias("ts"), F.array(F.col("id").cast("double")).alias("values"),
    )
    other = samples.filter("tick < 3").withColumn("equipment_id", F.lit("m2"))
    calibration.calibration_append(samples.unionByName(other), path)
    before = {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    config = config_table(spark, config_row(tags=("a",), keep="60h"), config_row("m2", tags=("a",)))
    now = spark.createDataFrame([("m1", 15 * day + 23 * 3600)], "equipment_id string, s long")
    calibration.prune_store(spark, path, config, now.select("equipment_id", F.timestamp_seconds("s").alias("now")))
    after = {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    left = calibration.calibration_table(spark, path).select("equipment_id", "tick").collect()
    assert sorted(r["tick"] for r in left if r["equipment_id"] == "m1") == list(range(5 * 24 + 23 - 60, 6 * 24))
    # An equipment that ``now`` leaves out keeps its samples.
    assert sorted(r["tick"] for r in left if r["equipment_id"] == "m2") == [0, 1, 2]
    days = lambda files: {f.split("day=")[1][:10] for f in files}
    border = "1970-01-14"
    assert days(after.keys() - before.keys()) == {border}
    assert {f for f in before if days([f]) > {border}} <= after.keys() and not any("bucket" in f and days([f]) == {"1970-01-12"} for f in after)
    calibration.prune_store(spark, path, config, now.select("equipment_id", F.timestamp_seconds("s").alias("now")))
    assert {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")} == after


def test_append_splits_a_hot_day(spark, tmp_path):
    """One day and bucket larger than the advisory size is written by several tasks."""
    samples = spark.range(200_000).select(
        F.lit("m1").alias("equipment_id"), F.lit(0).cast("long").alias("episode"), F.col("id").alias("tick"),
        F.timestamp_millis(F.col("id")).alias("ts"), F.array(F.rand(1), F.rand(2)).alias("values"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    calibration.calibration_append(samples.repartition(8), str(tmp_path / "s"))
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "s").rglob("*.parquet"))) > 1
    assert calibration.calibration_table(spark, str(tmp_path / "s")).count() == 200_000


def test_damaged_sample_lines_are_skipped(spark, tmp_path):
    lines = [
        '{"timestamp": "2026-08-03T00:00:00+00:00", "values": {"a": 1.5, "b": null}}',
        '{"timestamp": "2026-08-0',
        '{"values": {"a": 1}}',
        '{"timestamp": "2026-08-03T00:00:00+00:00"}',
        "",
        "[1]",
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    got = calibration.calibration_read(spark, str(tmp_path)).collect()
    assert [(r["ts"].timestamp(), r["values"]) for r in got] == [(at(0).timestamp(), {"a": 1.5, "b": None})]


def test_a_refused_train_names_the_tags_it_never_saw(spark):
    """Only values among the samples of the train's own episode count; tags come in the order of the config."""
    config = config_table(spark, config_row(tags=("d", "a", "b", "c"), window=1))
    rows = [("m1", "a", s, 1.0) for s in range(30)] + [("m1", "c", 2, 5.0), ("m1", "c", 3, None), ("m1", "b", 25, 1.0)]
    log = [("m1", 10, "recalibrate"), ("m1", 5, "train"), ("m1", 12, "train"), ("m1", 10.5, "train"), ("m1", 28, "train")]
    snaps, attempts, _ = intervals(spark, rows, log, config.withColumn("min_samples", F.lit(2)), size=4)
    got = unseen_tags(attempts, snaps, config, size=4)
    found = {r["tick"] - tick(0): (r["reason"], r["unseen_tags"]) for r in got.collect()}
    refused = "no full window to train on"
    assert found == {5: (refused, ["d", "b"]), 11: ("too few samples", None), 12: (refused, ["d", "b", "c"]), 28: (refused, ["d", "c"])}
