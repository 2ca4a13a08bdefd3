import os
import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millwatch.operators.inspection import FEATURES, ml_feature_table
from millwatch.operators.scoring import debounce
from millwatch.operators.snapshots import asof_snapshot, number_snapshots, with_window_state
from millwatch.plans.monitor import fit_models, score_rows
from millwatch.streaming import minutes, telemetry
from millwatch.streaming.state import BatchTables
from tests.conftest import at, config_row, config_table, readings_table, tick
from tests.test_inspection import minutes as labelled_minutes
from tests.test_snapshots import machine_rows


@pytest.fixture(scope="module")
def plant(spark):
    rng = random.Random(11)
    plan = {"m1": (("a", "b"), 2), "m2": (("a",), 3)}
    rows = [r for m, (tags, _) in plan.items() for r in machine_rows(rng, m, tags, 60)]
    config = config_table(spark, *[config_row(m, tags, window=w) for m, (tags, w) in plan.items()]).cache()
    return rows, config


def batch_windows(spark, rows, config, until):
    """Batch snapshots up to ``until``, a second or one per equipment."""
    ends = until if isinstance(until, dict) else {r[0]: until for r in rows}
    kept = [r for r in rows if r[2] <= ends[r[0]]]
    end = F.element_at(F.create_map(*[F.lit(x) for e, u in ends.items() for x in (e, tick(u))]), F.col("equipment_id"))
    numbered = number_snapshots(asof_snapshot(readings_table(spark, kept), config, until=end))
    return with_window_state(numbered, config)


def triples(df):
    return sorted((r["equipment_id"], r["tick"], r["seq"], list(r["values"]), r["prev"], r["usable"]) for r in df.collect())


def test_batches_of_any_cut_and_order_give_the_batch_result(spark, plant, tmp_path):
    """Readings arrive up to 5 s late and in uneven parts; one part is empty; one batch runs twice."""
    rows, config = plant
    rng = random.Random(4)
    stamped = [(e, t, s, v, i) for i, (e, t, s, v) in enumerate(rows)]
    arrival = sorted(stamped, key=lambda r: r[2] + rng.random() * 5)
    cuts = [0, 20, 20, 55, len(arrival)]
    all_rows = readings_table(spark, rows).cache()
    tables = BatchTables(spark, str(tmp_path))
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = all_rows.filter(F.col("ord").isin([r[4] for r in arrival[lo:hi]]))
        for _ in range(2 if n == 2 else 1):
            telemetry.snapshot_step(part, config, tables, n, delay_ms=6000)
    got = tables.all_batches("snapshots", telemetry.SNAPSHOT_SCHEMA)
    closed = {m: max(r[2] for r in rows if r[0] == m) - 6 for m in ("m1", "m2")}
    assert triples(got) == triples(batch_windows(spark, rows, config, closed))


def test_late_reading_of_a_closed_tick_is_dropped(spark, tmp_path):
    config = config_table(spark, config_row(tags=("a",), window=1))
    tables = BatchTables(spark, str(tmp_path))
    telemetry.snapshot_step(readings_table(spark, [("m1", "a", 1, 1.0), ("m1", "a", 5, 2.0)]), config, tables, 0, 0)
    telemetry.snapshot_step(readings_table(spark, [("m1", "a", 3, 9.0), ("m1", "a", 7, 3.0)]), config, tables, 1, 0)
    got = {r["tick"] - tick(0): r["values"][0] for r in tables.all_batches("snapshots", telemetry.SNAPSHOT_SCHEMA).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0, 6: 2.0, 7: 3.0}
    late = tables.all_batches("late", telemetry.LATE_SCHEMA).collect()
    assert [(r["equipment_id"], r["tick"] - tick(0)) for r in late] == [("m1", 3)]


def test_a_wrong_stamp_holds_back_no_other_equipment(spark, tmp_path):
    config = config_table(spark, *[config_row(m, ("a",), window=1) for m in ("m1", "m2")])
    parts = [
        [("m1", "a", 1, 1.0), ("m1", "a", 3, 2.0), ("m2", "a", 5_000, 9.0)],
        [("m1", "a", 4, 3.0), ("m1", "a", 6, 4.0)],
    ]
    tables = BatchTables(spark, str(tmp_path))
    for n, part in enumerate(parts):
        telemetry.snapshot_step(readings_table(spark, part), config, tables, n, 0)
    rows = tables.all_batches("snapshots", telemetry.SNAPSHOT_SCHEMA).collect()
    assert {r["tick"] - tick(0): r["values"][0] for r in rows if r["equipment_id"] == "m1"} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 4}
    assert len([r for r in rows if r["equipment_id"] == "m2"]) == 1
    assert tables.all_batches("late", telemetry.LATE_SCHEMA).isEmpty()


def test_receipt_bounds_stamps_and_keeps_silent_equipment_ticking(spark, tmp_path):
    config = config_table(spark, *[config_row(m, ("a",), window=1) for m in ("m1", "m2")])
    parts = [[("m1", "a", 1, 1.0), ("m2", "a", 5_000, 9.0), ("m2", "a", 1, 5.0)], [("m1", "a", 4, 3.0)]]
    tables = BatchTables(spark, str(tmp_path))
    for n, (part, at) in enumerate(zip(parts, (2, 4))):
        rows = readings_table(spark, part)
        first = readings_table(spark, [("m1", "a", at, 0.0)]).select(F.col("ts").alias("received_at"))
        telemetry.snapshot_step(rows.join(first, F.lit(True)), config, tables, n, 0)
    got = tables.all_batches("snapshots", telemetry.SNAPSHOT_SCHEMA).collect()
    assert {r["tick"] - tick(0): r["values"][0] for r in got if r["equipment_id"] == "m2"} == {1: 5, 2: 5, 3: 5, 4: 5}


def test_monitor_steps_equal_batch_scoring(spark, plant, tmp_path):
    rows, config = plant
    whole = batch_windows(spark, rows, config, 59).cache()
    models = fit_models(whole.withColumns({"model_version": F.lit(0).cast("long"), "fit": F.col("usable")}), config).cache()
    live = whole.withColumn("model_version", F.lit(0).cast("long")).filter("usable")
    want = debounce(score_rows(live, models, config), threshold=0.2, confirm=3)
    tables = BatchTables(spark, str(tmp_path))
    for n, (lo, hi) in enumerate([(0, 13), (13, 14), (14, 40), (40, 99)]):
        part = whole.filter((F.col("tick") >= tick(lo)) & (F.col("tick") < tick(hi)))
        telemetry.monitor_step(part, None, models, config, tables, n, threshold=0.2, confirm=3)
    got = tables.all_batches("alarms", telemetry.ALARM_SCHEMA)

    def view(df):
        return sorted((r["equipment_id"], r["tick"], round(r["anomaly_score"], 9), r["alarm"]) for r in df.collect())

    assert view(got) == view(want) and any(r[3] for r in view(got))


@pytest.mark.parametrize("cuts", [(0, 1000, 1001, 2600), (0, 2600)])
def test_minute_steps_equal_batch_features(spark, tmp_path, cuts):
    rng = random.Random(2)
    counts = {7_000 + m: rng.choice([0, 1, 5]) for m in range(2600) if rng.random() < 0.5 and not 300 < m < 900}
    counts[7_000], counts[7_000 + 2599] = 2, 2
    want = ml_feature_table(labelled_minutes(spark, counts)).select("minute", "ng", *FEATURES).orderBy("minute").toPandas()
    tables = BatchTables(spark, str(tmp_path))
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = [("s", m, c) for m, c in counts.items() if lo <= m - 7_000 < hi]
        minutes.feature_step(spark.createDataFrame(part, "series_id string, minute long, ng long"), tables, n)
    got = tables.all_batches("features", minutes.FEATURE_SCHEMA).orderBy("minute").toPandas()
    assert (got["minute"].to_numpy() == want["minute"].to_numpy()).all()
    for c in ("ng", *FEATURES):
        assert abs(got[c] - want[c]).max() < 1e-9, c


def test_beats_close_the_ticks_of_a_silent_line(spark, plant, tmp_path):
    """No reading arrives after the first batch, but snapshots, scores and the alarm go on as in a batch job up to the last beat."""
    rows, config = plant
    received = F.col("ts").alias("received_at")
    first = readings_table(spark, rows).select("*", received)
    tables = BatchTables(spark, str(tmp_path))
    beats = [readings_table(spark, [("m1", "a", s, 0.0)]).select(received) for s in (70, 70, 95)]
    nothing = first.limit(0)
    for n, part in enumerate([first, *(telemetry.with_heartbeats(nothing, b) for b in beats)]):
        telemetry.snapshot_step(part, config, tables, n, 0)
    got = tables.all_batches("snapshots", telemetry.SNAPSHOT_SCHEMA)
    whole = batch_windows(spark, rows, config, 95)
    assert triples(got) == triples(whole)
    models = fit_models(whole.withColumns({"model_version": F.lit(0).cast("long"), "fit": F.col("usable")}), config).cache()
    live = whole.withColumn("model_version", F.lit(0).cast("long")).filter("usable")
    want = debounce(score_rows(live, models, config), threshold=0.01, confirm=3)
    for n in range(4):
        telemetry.monitor_step(tables.read("snapshots", n, telemetry.SNAPSHOT_SCHEMA), None, models, config, tables, n, threshold=0.01, confirm=3)
    alarms = tables.all_batches("alarms", telemetry.ALARM_SCHEMA)
    assert sorted((r["equipment_id"], r["tick"], r["alarm"]) for r in alarms.collect()) == sorted((r["equipment_id"], r["tick"], r["alarm"]) for r in want.collect())
    with pytest.raises(ValueError):
        telemetry.with_heartbeats(readings_table(spark, rows), beats[0])


def test_the_wall_clock_drives_a_dead_feed(spark, tmp_path):
    """A running stream gives out ticks by the beats of Spark's rate source alone."""
    config = config_table(spark, config_row(tags=("a",), window=1))
    now = F.current_timestamp()
    landed = readings_table(spark, [("m1", "a", 0, 7.0)]).withColumns({"ts": now, "received_at": now})
    landed.write.parquet(str(tmp_path / "landed"))
    source = spark.readStream.schema(landed.schema).parquet(str(tmp_path / "landed"))
    root = str(tmp_path / "run")
    query = telemetry.stream_snapshots(source, lambda: config, root, 0, beats=telemetry.heartbeats(spark), processingTime="1 second")
    try:
        deadline = time.time() + 60
        found = []
        while time.time() < deadline and len(found) < 5:
            time.sleep(2)
            found = BatchTables(spark, root).all_batches("snapshots", telemetry.SNAPSHOT_SCHEMA).collect()
    finally:
        query.stop()
    ticks = sorted(r["tick"] for r in found)
    assert len(ticks) >= 5 and ticks == list(range(ticks[0], ticks[0] + len(ticks))) and {r["values"][0] for r in found} == {7.0}


def test_tables_are_compacted(spark, tmp_path):
    """After many batches few folders are left, each row is there once, and a batch that runs again changes nothing."""
    tables = BatchTables(spark, str(tmp_path), every=3, fan=2)
    rows = lambda n: spark.range(n, n + 2).select(F.col("id").alias("v"))
    for n in range(26):
        for _ in range(2 if n in (6, 7, 12) else 1):
            tables.write(rows(n), "out", n)
            tables.write_state(rows(n), "held", n)
    want = sorted((v, n) for n in range(26) for v in (n, n + 1))
    read = lambda **more: sorted(map(tuple, tables.all_batches("out", "v BIGINT", keep_batch=True, **more).collect()))
    assert read() == want and read(upto=24) == [w for w in want if w[1] <= 24]
    folders = [f for f in os.listdir(tmp_path / "out") if not f.startswith("_")]
    assert len(folders) <= 2 * 3 + 2 * 5 and len(os.listdir(tmp_path / "held")) == 2
    assert len([f for f in os.listdir(tmp_path / "out" / "_manifest") if f.endswith(".json")]) <= 2
    # A batch folder without its commit mark is not read.
    os.remove(tmp_path / "out" / "batch=000000025" / "_SUCCESS")
    assert read() == [w for w in want if w[1] < 25]
    assert BatchTables(spark, str(tmp_path / "none")).all_batches("out", "v BIGINT").isEmpty()


def test_late_inspections_are_corrected(spark, tmp_path):
    """Any order of arrival ends in the batch table; what lies past the horizon is listed and changes nothing."""
    rng = random.Random(9)
    counts = {7_000 + m: rng.choice([0, 1, 5]) for m in range(1500) if rng.random() < 0.4 and not 300 < m < 700}
    counts[7_000], counts[7_000 + 1499] = 2, 2
    rows = [(m, ng) for m, c in counts.items() for ng in ([1] * c or [0])]
    order = sorted(rows, key=lambda r: r[0] + rng.random() * 900)
    schema = "series_id string, inspected_at timestamp, is_ng int"
    frame = lambda some: spark.createDataFrame([("s", datetime.fromtimestamp(m * 60 + 7, timezone.utc), ng) for m, ng in some], schema)
    tables = BatchTables(spark, str(tmp_path))
    size = len(order) // 4 + 1
    for n in range(4):
        for _ in range(2 if n == 2 else 1):
            minutes.change_step(frame(order[n * size : (n + 1) * size]), tables, n, horizon=1600)
    want = ml_feature_table(labelled_minutes(spark, counts)).select("minute", "ng", *FEATURES).orderBy("minute").toPandas()

    def latest():
        return minutes.latest_features(tables).orderBy("minute").toPandas()

    got = latest()
    assert (got["minute"].to_numpy() == want["minute"].to_numpy()).all() and got.revision.nunique() > 1
    for c in ("ng", *FEATURES):
        assert abs(got[c] - want[c]).max() < 1e-9, c
    assert tables.all_batches("late", minutes.LATE_SCHEMA).isEmpty()
    minutes.change_step(frame([(7_010, 1), (7_010, 1), (7_000 + 1498, 1)]), tables, 4, horizon=100)
    again = latest()
    assert [tuple(r) for r in tables.all_batches("late", minutes.LATE_SCHEMA).collect()] == [("s", 7_010, 2)]
    changed = again[again.ng.to_numpy() != got.ng.to_numpy()]
    assert changed.minute.tolist() == [7_000 + 1498] and set(again[again.revision == 4].minute) == {7_000 + 1498, 7_000 + 1499}
    minutes.change_step(frame([]), tables, 5, horizon=100)
    assert len(latest()) == len(got)


def test_minutes_are_finished_with_the_batch_that_passes_them(spark, tmp_path):
    """Open minutes are carried, late rows of finished ones dropped, and a batch that runs again gives the same."""
    tables, schema = BatchTables(spark, str(tmp_path)), "series_id string, at long, is_ng int"
    batches = [
        [("s", 600, 1), ("s", 659, 1), ("s", 665, 1), ("t", 725, 0), (None, 600, 1), ("t", None, 1)],
        [("s", 640, 9), ("s", 719, 1), ("s", 726, 1), ("s", 790, 0)],
        [("t", 700, 9), ("t", 911, 1)],
    ]
    got = []
    for n, rows in [*enumerate(batches[:2]), *list(enumerate(batches))[1:]]:
        part = spark.createDataFrame(rows, schema).select("series_id", F.timestamp_seconds("at").alias("inspected_at"), "is_ng")
        got.append({tuple(r) for r in minutes.finished_minutes(part, tables, n, "10 seconds").collect()})
    assert got[0] == {("s", 10, 2), (None, 10, 1)}
    assert got[1] == got[2] == {("s", 11, 2), ("s", 12, 1), ("t", 12, 0)}
    assert got[3] == {("s", 13, 0)}


def test_newest_features_are_found_without_gathering_them(spark, tmp_path):
    """Of each minute the newest revision, with one row per series and revision compared and no feature sorted or exchanged."""
    stamp = lambda m: datetime.fromtimestamp(m * 60, timezone.utc)
    parts = [[("s", 10, 1), ("s", 14, 0), ("t", 5, 1)], [("s", 12, 1), ("s", 15, 0)], [("t", 7, 0), ("u", 3, 1)], [("s", 11, 1), ("t", 9, 1)]]
    tables = BatchTables(spark, str(tmp_path))
    for n, part in enumerate(parts):
        rows = spark.createDataFrame([(s, stamp(m), ng) for s, m, ng in part], "series_id string, inspected_at timestamp, is_ng int")
        minutes.change_step(rows, tables, n, horizon=100)
    latest = minutes.latest_features(tables)
    got = {(r["series_id"], r["minute"]): r["revision"] for r in latest.collect()}
    want = {}
    for r in tables.all_batches("changes", minutes.CHANGE_SCHEMA).collect():
        want[r["series_id"], r["minute"]] = max(r["revision"], want.get((r["series_id"], r["minute"]), 0))
    assert got == want and set(got.values()) == {0, 1, 2, 3} - {1} and latest.count() == len(want)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan


def test_control_fits_from_a_table_of_the_training_rows(spark, plant, tmp_path, monkeypatch):
    """Both passes of a fit read the rows of the new models alone, and that table goes with the batch."""
    rows, config = plant
    seen = []
    monkeypatch.setattr(telemetry, "fit_models", lambda df, *more: seen.append((df._jdf.queryExecution().optimizedPlan().toString(), df.count())) or fit_models(df, *more))
    history = batch_windows(spark, rows, config, 59).cache()
    log = spark.createDataFrame([("m1", at(30), "train", 0), ("m2", at(40), "recalibrate", 1)], telemetry.COMMAND_SCHEMA)
    tables = BatchTables(spark, str(tmp_path))
    telemetry.control_step(log, history, config, tables, 0)
    plan, found = seen[0]
    assert "Join" not in plan and found == history.filter((F.col("equipment_id") == "m1") & (F.col("tick") < tick(30))).count() > 0
    models = tables.all_batches("models", telemetry.MODEL_SCHEMA).collect()
    assert [(m["equipment_id"], m["model_version"]) for m in models] == [("m1", 0)]
    assert not os.path.exists(tables.path("training", 0))


def test_points_of_a_batch_are_gathered_once(spark, plant, tmp_path, monkeypatch):
    """New readings and waiting points meet in one aggregation, and the tail holds no more than the next windows look back on."""
    rows, config = plant
    tables, seen = BatchTables(spark, str(tmp_path)), {}
    write = BatchTables.write_state
    monkeypatch.setattr(BatchTables, "write_state", lambda self, df, name, batch: seen.update({name: df}) or write(self, df, name, batch))
    telemetry.snapshot_step(readings_table(spark, rows), config, tables, 0, 0)
    assert seen["points"]._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert "prev" not in spark.read.parquet(tables.path("tail", 0)).columns
