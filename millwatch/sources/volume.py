"""Telemetry and inspection inputs derived from the event and line-item tables.

Each adapter is a deterministic projection, so its size follows the table it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.functions.scalars import POSITIONS
from millwatch.session import configure, stage

TAGS = ("click", "error", "purchase", "signup", "view")
INTERVAL_MS = 3_600_000
WINDOW = 6
MIN_SAMPLES = 48
MAX_DURATION = "7d"
USERS_PER_EQUIPMENT = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    unit = F.floor(F.col("user_id") / F.lit(USERS_PER_EQUIPMENT))
    return e.select(
        F.concat(F.lit("eq"), unit.cast("string")).alias("equipment_id"),
        F.col("event_type").alias("tag"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", (F.col("value") >= 50).cast("double"))
        .otherwise(F.col("value"))
        .alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("event_id").alias("ord"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long readings. k = 7 sends an explicit null; k = 8 nulls every tag of the equipment at once."""
    e = event_rows(spark, sf_dir)
    tags = F.when(F.col("k") == 8, F.array(*[F.lit(t) for t in TAGS])).otherwise(F.array("tag"))
    return e.select(
        "equipment_id",
        F.explode(tags).alias("tag"),
        "ts",
        F.when(~F.col("k").isin(7, 8), F.col("value")).alias("value"),
        "ord",
    )


_CONFIG: dict[tuple[str, str], DataFrame] = {}


def equipment_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings table of the equipments that occur in ``events``, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONFIG:
        _CONFIG[key] = stage(_config_of_events(spark, sf_dir), "equipment-config")
    return _CONFIG[key]


def _config_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        event_rows(spark, sf_dir)
        .groupBy("equipment_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "equipment_id",
            F.array(
                F.concat(F.lit("plant/"), "equipment_id", F.lit("/a")),
                F.concat(F.lit("plant/"), "equipment_id", F.lit("/b")),
            ).alias("subscribe_topics"),
            F.concat(F.lit("alarms/"), "equipment_id").alias("publish_topic"),
            F.concat(F.lit("control/"), "equipment_id").alias("command_topic"),
            F.array(*[F.lit(t) for t in TAGS]).alias("tags"),
            F.lit(INTERVAL_MS).alias("resample_interval_ms"),
            F.lit(WINDOW).alias("window_size"),
            F.lit(MAX_DURATION).alias("max_duration"),
            F.lit(MIN_SAMPLES).alias("min_samples"),
        )
    )


def settings_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with a change half-way through the events: of four machines one keeps all, one loses a tag, one gets another
    window, and one another tag order and a smaller sample count, which break nothing."""
    config = equipment_config(spark, sf_dir)
    lo, hi = table(spark, sf_dir, "events").agg(*(f(F.unix_micros(F.col("ts").cast("timestamp"))) for f in (F.min, F.max))).first()
    n = F.substring("equipment_id", 3, 10).cast("int") % 4
    later = config.filter(n > 0).withColumns(
        {
            "tags": F.when(n == 1, F.slice("tags", 1, 4)).when(n == 3, F.reverse("tags")).otherwise(F.col("tags")),
            "window_size": F.when(n == 2, F.lit(4)).otherwise(F.col("window_size")),
            "min_samples": F.when(n == 3, F.lit(24)).otherwise(F.col("min_samples")),
        }
    )
    since = F.lit(None).cast("timestamp")
    return config.withColumn("valid_from", since).unionByName(later.withColumn("valid_from", F.timestamp_micros(F.lit((lo + hi) // 2))))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command messages: k = 0 recalibrates, 1 to 3 train, 4 to 6 are payloads to be ignored."""
    e = event_rows(spark, sf_dir).filter(F.col("k").between(0, 6))
    payload = (
        F.when(F.col("k") == 0, '{"command":"recalibrate"}')
        .when(F.col("k").between(1, 3), '{"command":"train"}')
        .when(F.col("k") == 4, '{"command":"pause"}')
        .when(F.col("k") == 5, "train")
        .otherwise('{"order":"train"}')
    )
    return e.select("equipment_id", "ts", payload.cast("binary").alias("payload"), "ord")


def message_text(k: Column, tag: Column, value: Column, stamp: Column) -> Column:
    """One payload per event; some k give malformed or unusual messages, 15 gives bytes that are no text."""

    def field(v: Column | str) -> Column:
        return F.concat(F.lit('"'), tag, F.lit('":'), F.lit(v) if isinstance(v, str) else v)

    number = F.format_string("%.2f", value)
    stamped = F.concat(F.lit('"timestamp":"'), stamp, F.lit('",'))

    def one(body: Column) -> Column:
        return F.concat(F.lit('{"records":[{'), body, F.lit("}]}"))

    all_null = ",".join(f'"{t}":null' for t in TAGS)
    plain = F.concat(F.lit("{"), stamped, field(number), F.lit("}"))
    return (
        F.when(k == 7, one(F.concat(stamped, field("null"))))
        .when(k == 8, one(F.concat(stamped, F.lit(all_null))))
        .when(k == 11, F.concat(F.lit('{"records":['), plain))
        .when(k == 12, '{"records": 7}')
        .when(k == 13, F.concat(F.lit('{"records":[4.5,'), plain, F.lit(",[]]}")))
        .when(k == 14, F.concat(F.lit("["), plain, F.lit("]")))
        .when(k == 16, one(field(number)))
        .when(k == 17, one(F.concat(F.lit('"timestamp":null,'), field(number))))
        .when(k == 18, F.concat(F.lit('{"records":['), plain, F.lit(","), plain, F.lit("]}")))
        .when(k == 19, one(F.concat(stamped, field("true"))))
        .when(k == 20, F.concat(F.lit('{"records":{"a":'), plain, F.lit("}}")))
        .when(k == 21, F.concat(F.lit('{"records":["'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"]}')))
        .when(k == 22, one(F.concat(stamped, F.lit('"unrelated":1.0'))))
        .when(k == 23, one(F.concat(F.lit('"timestamp":"soon",'), field(number))))
        .otherwise(one(F.concat(stamped, field(number))))
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages; topic a or b of the equipment, or (k = 24) a topic nobody subscribes to."""
    e = event_rows(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = message_text(F.col("k"), F.col("tag"), F.col("value"), stamp)
    leaf = F.when(F.col("ord") % 2 == 0, "/a").otherwise("/b")
    return e.select(
        F.when(F.col("k") == 24, "plant/none").otherwise(F.concat(F.lit("plant/"), "equipment_id", leaf)).alias("topic"),
        F.when(F.col("k") == 15, F.unhex(F.lit("C3287B"))).otherwise(text.cast("binary")).alias("payload"),
        F.col("ts").alias("received_at"),
        F.col("ord").alias("offset"),
    )


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide inspection rows from line items: one minute per order, one series per return flag.

    Defects come in bursts of orders, so some hours hold four failures and others none.
    """
    order, line = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    noise, fault, place = F.col("noise"), F.col("fault"), F.col("place")
    burst = F.when(F.floor(order / F.lit(120)) % 5 == 0, F.lit(90)).otherwise(F.lit(15))
    li = (
        table(spark, sf_dir, "lineitem")
        .withColumn("noise", order * 31 + line * 17 + F.col("l_partkey") * 7)
        .withColumn("base", order * 7919 + line * 104729)
        .withColumn("fault", F.when(noise % 1000 < burst, noise % 4 + 1).otherwise(F.lit(0)))
        .withColumn("place", noise % 12 + 1)
    )
    at = F.timestamp_seconds(F.lit(1704067200) + order * 60 + line * 5)

    def measure(kind: str, side: str, pos: int) -> Column:
        salt = pos * 1299709 + (15485863 if side == "R" else 32452843) + (49979687 if kind == "X" else 0)
        h = (F.col("base") + F.lit(salt)) % 10007
        here = place == pos
        if kind == "A":
            value = h % 2001 + 109000
            if side == "L":
                value = F.when(here & (fault == 1), F.lit(113001)).otherwise(value)
        else:
            value = h % 61 + 840
            value = F.when(here & (fault == 2), F.lit(820 if side == "L" else 920)).otherwise(value)
            if side == "R":
                value = F.when(here & (fault == 3), F.lit(None)).otherwise(value)
            else:
                value = F.when(here & (fault == 4), F.lit(819)).otherwise(value)
        return value.cast("double").alias(f"{kind}_{side}_{pos:02d}")

    date = F.when(noise % 997 == 5, F.lit("2024133x")).otherwise(F.date_format(at, "yyyyMMdd"))
    return li.select(
        F.col("l_returnflag").alias("series_id"),
        F.concat_ws("-", order.cast("string"), line.cast("string"), F.col("l_partkey").cast("string")).alias("row_id"),
        date.alias("INSP_DATE"),
        # The source writes times as plain numbers, without leading zeros.
        F.date_format(at, "HHmmss").cast("int").cast("string").alias("INSP_TIME"),
        *[measure(k, s, int(p)) for k in "AX" for s in "LR" for p in POSITIONS],
    )
