import json

import pytest
from pyspark.sql import functions as F

from millwatch.functions.scalars import parse_command, parse_duration, state_or_default, tick_of
from millwatch.operators.parse import config_rows, parse_commands, parse_records, record_entries
from millwatch.sources.messages import MESSAGE_SCHEMA, land_messages, message_scan
from tests.conftest import CONFIG_SCHEMA, at, config_row, config_table

T = "2026-08-03T00:00:00Z"


def parse(spark, payload, tags=("a",)):
    raw = payload if isinstance(payload, bytes) else payload.encode()
    messages = spark.createDataFrame([("in/m1", bytearray(raw), at(60), 7)], MESSAGE_SCHEMA)
    rows = parse_records(messages, config_table(spark, config_row(tags=tags))).collect()
    return sorted((r["tag"], r["value"], r["ts"].timestamp()) for r in rows)


def record(**fields):
    return json.dumps({"records": [{"timestamp": T, **fields}]})


@pytest.mark.parametrize(
    "payload",
    [
        f'{{"records":[{{"timestamp":"{T}","a":1}}]',
        '{"records": 7}',
        f'[{{"timestamp":"{T}","a":1}}]',
        b'{"records":[{"timestamp":1,"a":1,"b":"\xc3("}]}',
        '{"records":{"a":{"timestamp":1,"a":1}}}',
        json.dumps({"records": [json.dumps({"timestamp": T, "a": 1})]}),
        '{"records":[{"a":1}]}',
        '{"records":[{"timestamp":null,"a":1}]}',
        '{"records":[]}',
        "{}",
        "",
    ],
)
def test_unusable_payload_gives_nothing(spark, payload):
    assert parse(spark, payload) == []


def test_only_configured_tags_are_kept(spark):
    payload = record(**{"s:torque": 0.25, "s:other": 8.5, "s:A": -3.0})
    got = parse(spark, payload, ("s:torque", "s:A"))
    assert [(t, v) for t, v, _ in got] == [("s:A", -3.0), ("s:torque", 0.25)]
    assert parse(spark, record(other=1.0)) == []


def test_good_sibling_of_a_bad_element_survives(spark):
    payload = json.dumps({"records": [4.5, {"timestamp": T, "a": 1.0}, []]})
    assert len(parse(spark, payload)) == 1


def test_unreadable_stamp_falls_back_to_receipt(spark):
    payload = '{"records":[{"timestamp":"soon","a":1.0},{"timestamp":5,"a":2.0}]}'
    assert [ts for _, _, ts in parse(spark, payload)] == [at(60).timestamp()] * 2
    assert parse(spark, record(a=1.0))[0][2] == at(0).timestamp()


def test_clock_of_records(spark):
    payload = bytearray(f'{{"records":[{{"timestamp":"{T}","a":1}},{{"timestamp":"1999-01-01T00:00:00Z","a":2}}]}}'.encode())
    messages = spark.createDataFrame([("in/m1", payload, at(60), 7)], MESSAGE_SCHEMA)

    def times(**options):
        rows = parse_records(messages, config_table(spark), **options).orderBy("value").collect()
        return [r["ts"].timestamp() - at(0).timestamp() for r in rows]

    assert times(clock="arrival") == [60, 60]
    assert times(max_skew_s=3600) == [0, 60]
    assert times()[0] == 0 and times()[1] < -1e8
    with pytest.raises(ValueError):
        times(clock="sundial")


def test_values_of_other_types(spark):
    assert parse(spark, record(a=None))[0][1] is None
    assert parse(spark, record(a=True))[0][1] == 1.0
    assert parse(spark, record(a=False))[0][1] == 0.0
    assert parse(spark, record(a="1.5"))[0][1] == 1.5
    assert parse(spark, record(a="high"))[0][1] is None
    assert parse(spark, record(a=[1]))[0][1] is None


def test_repeated_key_keeps_the_last_value(spark):
    assert parse(spark, f'{{"records":[{{"timestamp":"{T}","a":1,"a":2}}]}}')[0][1] == 2.0


def test_topic_of_nobody_is_dropped(spark):
    messages = spark.createDataFrame([("elsewhere", bytearray(record(a=1).encode()), at(0), 1)], MESSAGE_SCHEMA)
    assert parse_records(messages, config_table(spark)).count() == 0


def test_json_is_parsed_once(spark):
    messages = spark.createDataFrame([("in/m1", bytearray(b"{}"), at(0), 1)], MESSAGE_SCHEMA)
    plan = record_entries(messages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_landed_messages_read_back(spark, tmp_path):
    messages = spark.createDataFrame([("in/m1", bytearray(record(a=1).encode()), at(0), i) for i in range(3)], MESSAGE_SCHEMA)
    land_messages(messages, str(tmp_path / "m"))
    assert message_scan(spark, str(tmp_path / "m")).count() == 3
    assert message_scan(spark, str(tmp_path / "m"), streaming=True).isStreaming


@pytest.mark.parametrize(
    "payload,word",
    [
        ('{"command":"train"}', "train"),
        ('{"command":"recalibrate"}', "recalibrate"),
        ("train", None),
        ('{"command":"pause"}', None),
        ('{"order":"train"}', None),
        ('["train"]', None),
        ('{"command":["train"]}', None),
    ],
)
def test_command_words(spark, payload, word):
    row = spark.createDataFrame([(bytearray(payload.encode()),)], "payload binary")
    assert row.select(parse_command(F.col("payload")).alias("c")).first()["c"] == word
    assert parse_commands(row).count() == (word is not None)


@pytest.mark.parametrize(
    "text,seconds",
    [("7d", 604800), ("12h", 43200), ("30m", 1800), ("45s", 45), (" 7d \n", 604800), ("7 d", None), ("d", None),
     ("7w", None), ("", None), ("-1d", None), ("1.5h", None), (None, None)],
)
def test_durations(spark, text, seconds):
    row = spark.createDataFrame([(text,)], "t string")
    assert row.select(parse_duration(F.col("t")).alias("s")).first()["s"] == seconds


def test_state_words(spark):
    rows = spark.createDataFrame([("MONITORING",), (" MONITORING\n",), ("garbled",), (None,)], "s string")
    assert [r[0] for r in rows.select(state_or_default(F.col("s"))).collect()] == ["MONITORING"] * 2 + ["CALIBRATING"] * 2


def test_tick_edges(spark):
    """A tick covers the half-open range up to and including its own time."""
    rows = spark.createDataFrame([(at(s),) for s in (0, 0.000001, 0.05, 0.050001, 0.1)], "ts timestamp")
    zero = int(at(0).timestamp() * 20)
    got = [r[0] - zero for r in rows.select(tick_of(F.col("ts"), 50)).collect()]
    assert got == [0, 1, 1, 2, 2]


def test_config_reasons(spark):
    good = config_row("ok", interval=50, window=100, keep="7d", min_samples=10_000)
    bad = {
        "subscribe_topics is missing": (1, None),
        "subscribe_topics is empty": (1, []),
        "publish_topic is missing": (2, None),
        "tags is empty": (4, []),
        "resample_interval_ms is not positive": (5, 0),
        "window_size is not positive": (6, -1),
        "max_duration is no duration": (7, "soon"),
        "max_duration is missing": (7, None),
        "min_samples is not positive": (8, 0),
    }
    rows = [good]
    for i, (place, value) in bad.items():
        row = list(good)
        row[0], row[place] = i, value
        rows.append(tuple(row))
    checked = {r["equipment_id"]: r for r in config_rows(spark.createDataFrame(rows, CONFIG_SCHEMA)).collect()}
    assert checked["ok"]["valid"] and checked["ok"]["max_duration_s"] == 604800
    for reason in bad:
        assert checked[reason]["reasons"] == [reason] and not checked[reason]["valid"]
