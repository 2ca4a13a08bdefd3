"""Physical plans: what reaches the scan, what is shuffled, what must never appear."""

import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millwatch import session
from millwatch.operators import inspection, model
from millwatch.operators.model import VERSION
from millwatch.operators.scoring import debounce
from millwatch.operators.snapshots import asof_snapshot, change_points, number_snapshots, with_window_state
from millwatch.plans.monitor import Settings, monitor, windowed_snapshots, with_models
from millwatch.session import scratch_path
from tests.conftest import config_row, config_table, readings_table

LAZY = Settings(stage=lambda df, name: df)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "readings")
    rng = random.Random(0)
    rows = [("hot", t, i, rng.random()) for i in range(300) for t in "ab"]
    rows += [(f"m{j}", t, i * 30, 1.0) for j in range(5) for i in range(10) for t in "ab"]
    readings_table(spark, rows).withColumn("unused", F.lit("x")).write.parquet(path)
    config = config_table(spark, *[config_row(m) for m in ("hot", "m0", "m1", "m2", "m3", "m4")]).cache()
    return spark.read.parquet(path), config


def test_scan_reads_needed_columns_and_reduces_before_the_shuffle(stored):
    readings, config = stored
    text = plan(change_points(readings, config))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "unused" not in scan.split("ReadSchema")[1]
    assert "partial_max_by" in text and "SortAggregate" not in text


def test_filter_on_the_series_reaches_the_scan(stored):
    readings, config = stored
    text = plan(windowed_snapshots(readings, config, LAZY).filter("equipment_id = 'hot'"))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("EqualTo(equipment_id,hot)" in line for line in scans)


def test_window_chain_never_partitions_by_equipment_alone_on_rows(stored):
    """Windows over rows carry a bucket; the two exceptions work on one row per bucket."""
    readings, config = stored
    text = plan(windowed_snapshots(readings, config, LAZY))
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Python" not in text
    for line in text.splitlines():
        if "+- Window" in line and "values#" in line:
            assert "bucket#" in line.split("windowspecdefinition")[1]


def test_no_window_of_a_snapshot_takes_a_whole_equipment_and_readings_are_read_once(spark, stored):
    readings, config = stored
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    text = plan(asof_snapshot(readings, config, 16))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    windows = [line.split("windowspecdefinition(")[1] for line in text.splitlines() if "+- Window" in line]
    assert windows and all("pos#" in w.split("specifiedwindowframe")[0] for w in windows)
    assert text.count("FileScan") - text.count("InMemoryTableScan") <= 2 and "ReusedExchange" in text


@pytest.mark.parametrize("broadcast_limit", ["10MB", "-1"])
def test_one_hot_equipment_is_spread_over_tasks(spark, stored, broadcast_limit):
    readings, config = stored
    # Small test partitions would be merged at run time. Without broadcasts, joins shuffle by equipment.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_limit)
    rows = with_window_state(number_snapshots(asof_snapshot(readings, config, 16), 16), config, 16)
    hot = rows.filter("equipment_id = 'hot'").withColumn("task", F.spark_partition_id())
    seen = len(hot.groupBy("task").agg(F.count_if("usable")).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen > 1


def test_debounce_shuffles_by_bucket(stored):
    readings, _ = stored
    scores = readings.select(
        "equipment_id", F.lit(1).cast("long").alias("model_version"), F.col("ord").alias("tick"), F.col("value").alias("anomaly_score")
    )
    text = plan(debounce(scores, size=64))
    assert "SinglePartition" not in text and "bucket" in text


def test_feature_table_sorts_rows_once(spark, tmp_path):
    rows = spark.range(500).select(
        F.lit("s").alias("series_id"), (F.col("id") % 300).alias("minute"), (F.col("id") % 2).cast("int").alias("is_ng")
    )
    text = plan(inspection.ml_feature_table(rows))
    assert "SinglePartition" not in text and "Python" not in text
    wide = [line for line in text.splitlines() if "Sort [" in line and "block" in line]
    assert len(wide) == 1


def test_whole_chain_has_no_python_and_no_cross_join(spark, stored):
    readings, config = stored
    log = spark.createDataFrame([("hot", None, "train", 1)], "equipment_id string, ts timestamp, command string, ord bigint")
    text = plan(monitor(readings, log, config, LAZY))
    for word in ("SinglePartition", "CartesianProduct", "NestedLoop", "Python", "ArrowEval", "MapInPandas"):
        assert word not in text, word


def test_fitting_exchanges_rows_by_bucket_and_again_before_error_sums(spark, stored):
    """Without broadcasts, a machine's rows meet their model by bucket, and sums per model follow another exchange."""
    readings, config = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = windowed_snapshots(readings, config, LAZY).withColumns({"model_version": F.lit(0).cast("long"), "fit": F.col("usable")})
    live = rows.select(*VERSION, "tick", "values", "prev")
    models = model.pack_model(model.fit_forecaster(rows))
    text = plan(model.error_stats(model.raw_errors(with_models(live, models))))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x and "bucket#" in x)
    final = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(equipment_id" in x and "pos#" in x)
    assert final < join


def test_a_cluster_without_a_shared_folder_is_an_error():
    def fake(master, **settings):
        return SimpleNamespace(conf=settings, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(fake("spark://host:7077"), "x")
    assert scratch_path(fake("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://store/tmp"}), "x").startswith("hdfs://store/tmp/")
    one, two = (scratch_path(fake("local[2]"), "x") for _ in range(2))
    assert one != two and one.split("millwatch/")[0] == two.split("millwatch/")[0]


def test_scratch_tables_leave_the_catalog_with_their_files(spark, monkeypatch):
    monkeypatch.setattr(session, "_STAGED", {})
    monkeypatch.setattr(session, "_TABLES", {})
    path, name = scratch_path(spark, "rows"), session.scratch_table(spark, "rows")
    spark.range(5).write.option("path", path).saveAsTable(name)
    assert spark.catalog.tableExists(name)
    session.clear_scratch(spark)
    assert not spark.catalog.tableExists(name) and not os.path.exists(path)


def test_inspection_files_are_packed(spark, tmp_path, monkeypatch):
    from millwatch.plans import queries

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    n = queries.all_queries()["inspection_scan"](spark, sf).count()
    written = sum(f.stat().st_size for f in (tmp_path / "inspections").rglob("part-*"))
    assert n == spark.read.parquet(f"{sf}/lineitem.parquet").count() and written < 200 * n
