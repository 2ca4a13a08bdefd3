import json
import random

import pytest
from pyspark.sql import functions as F

from millwatch.functions.scalars import floored_std
from millwatch.operators.buckets import add_run_length, asof_last, within_intervals
from millwatch.operators.scoring import debounce, result_envelope, top_deviant
from tests.conftest import config_row, config_table, tick

SCORES = "equipment_id string, model_version bigint, tick bigint, anomaly_score double"


def alarms(spark, scores, threshold=3.0, confirm=3, versions=None, size=4096):
    rows = [("m1", (versions or [1] * len(scores))[i], i, float(s)) for i, s in enumerate(scores)]
    out = debounce(spark.createDataFrame(rows, SCORES), threshold, confirm, size)
    return [r["alarm"] for r in out.orderBy("tick").collect()]


@pytest.mark.parametrize(
    "scores,confirm,want",
    [
        ([4, 2, 7, 3, 9], 2, [False, False, False, True, True]),
        ([3, 3.5, 8, 1, 6], 3, [False, False, True, False, False]),
        ([3.0, 2.999, 100], 1, [True, False, True]),
        ([9] * 6 + [0], 4, [False] * 3 + [True] * 3 + [False]),
    ],
)
def test_debounce_examples(spark, scores, confirm, want):
    assert alarms(spark, scores, confirm=confirm) == want


def test_new_model_starts_over(spark):
    assert alarms(spark, [6] * 7, versions=[4] * 4 + [9] * 3) == [False, False, True, True, False, False, True]


def test_confirm_must_be_positive(spark):
    with pytest.raises(ValueError):
        alarms(spark, [1], confirm=0)


@pytest.mark.parametrize("size", [1, 4, 10, 4096])
def test_debounce_equals_counter_loop_over_buckets(spark, size):
    rng = random.Random(size)
    rows, want, t = [], {}, 0
    for m in ("m1", "m2"):
        run = 0
        for _ in range(200):
            t += rng.choice([1, 1, 1, 7, 40])
            score = rng.choice([1.0, 5.0, 5.0, 5.0, 5.0])
            run = run + 1 if score >= 3 else 0
            rows.append((m, 1, t, score))
            want[(m, t)] = run >= 6
    got = debounce(spark.createDataFrame(rows, SCORES), 3.0, 6, size).collect()
    assert {(r["equipment_id"], r["tick"]): r["alarm"] for r in got} == want


@pytest.mark.parametrize("size", [3, 50])
def test_run_length_counts_across_buckets(spark, size):
    flags = [True] * 20 + [False] + [True] * 9
    df = spark.createDataFrame([("k", i, f) for i, f in enumerate(flags)], "k string, t bigint, f boolean")
    got = [r["run"] for r in add_run_length(df, ["k"], "t", F.col("f"), size).orderBy("t").collect()]
    assert got == list(range(1, 21)) + [0] + list(range(1, 10))


@pytest.mark.parametrize("size", [2, 9, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_equals_search(spark, size, inclusive):
    rng = random.Random(1)
    points = [("k%d" % (i % 3), t, f"v{t}" if rng.random() < 0.8 else None) for i, t in enumerate(rng.sample(range(300), 60))]
    probes = [("k%d" % (i % 4), t, i) for i, t in enumerate(rng.choices(range(320), k=150))]
    got = asof_last(
        spark.createDataFrame(probes, "k string, t bigint, id int"),
        spark.createDataFrame(points, "k string, t bigint, v string"),
        ["k"], "t", ["v"], size, inclusive,
    ).collect()
    assert len(got) == len(probes)
    for r in got:
        near = [(t, v) for k, t, v in points if k == r["k"] and v and (t <= r["t"] if inclusive else t < r["t"])]
        assert r["v"] == (max(near)[1] if near else None)


@pytest.mark.parametrize("size", [2, 9, 1000])
def test_intervals_equal_search(spark, size):
    rng = random.Random(3)
    spans = []
    for k in ("k0", "k1"):
        cuts = sorted(rng.sample(range(300), 12))
        spans += [(k, lo, hi, f"{k}:{lo}") for lo, hi in zip([None, *cuts], [*cuts, None])]
    spans += [("k2", 40, 60, "k2:40")]
    rows = [(f"k{i % 4}", t, i) for i, t in enumerate(rng.choices(range(300), k=200))]
    got = within_intervals(
        spark.createDataFrame(rows, "k string, t bigint, id int"),
        spark.createDataFrame(spans, "k string, lo bigint, hi bigint, name string"),
        ["k"], "t", "lo", "hi", size,
    ).collect()
    want = [
        (k, t, i, name) for k, t, i in rows for e, lo, hi, name in spans
        if e == k and (lo is None or t >= lo) and (hi is None or t < hi)
    ]
    assert sorted((r["k"], r["t"], r["id"], r["name"]) for r in got) == sorted(want)


def test_equal_scores_go_to_continuous_then_config_order(spark):
    rows = [
        (["b1", "c1", "c2"], ["binary", "continuous", "continuous"], [2.0, 2.0, 2.0]),
        (["b1", "c1", "b2"], ["binary", "continuous", "binary"], [3.0, 2.0, 3.0]),
    ]
    df = spark.createDataFrame(rows, "tags array<string>, tag_type array<string>, errors array<double>").withColumns(
        {"err_mean": F.array(*[F.lit(1.0)] * 3), "err_std": F.array(*[F.lit(0.5)] * 3)}
    )
    got = top_deviant(df).collect()
    assert [(r["top_deviant_tag"], r["anomaly_score"]) for r in got] == [("c1", 2.0), ("b1", 4.0)]


def test_spread_floor(spark):
    rows = spark.createDataFrame([(1.0, 0.5), (0.0, 0.0), (2.0, 0.0193), (-2.0, 0.0193)], "m double, s double")
    assert [r[0] for r in rows.select(floored_std(F.col("m"), F.col("s"))).collect()] == [0.5, 0.001, 0.1, 0.1]


def test_envelope(spark):
    tag = "Line:Blower.Cmd[0]"
    rows = spark.createDataFrame([("m1", 1, tick(5), 4.2, tag, True)], SCORES + ", top_deviant_tag string, alarm boolean")
    out = result_envelope(rows, config_table(spark, config_row("m1")), "edge").first()
    assert out["topic"] == "out/m1"
    assert json.loads(out["payload"]) == {
        "records": [
            {
                "timestamp": "2026-08-03T00:00:05.000000+00:00",
                "edge:anomaly_score": 4.2,
                "edge:alarm": True,
                "edge:top_deviant_tag": tag,
            }
        ]
    }
