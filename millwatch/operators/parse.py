"""Messages to tag readings, commands and checked equipment settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.functions.scalars import parse_command, parse_duration


def record_entries(messages: DataFrame) -> DataFrame:
    """Every key of every record in a readable message, typed.

    A message that is not a JSON object with a ``records`` list gives no rows; an element that is
    not an object is skipped and its siblings stay. Extra message columns are kept.
    """
    keep = [c for c in messages.columns if c != "payload"]
    body = F.try_parse_json(F.try_validate_utf8(F.col("payload").cast("string")))
    listed = F.try_variant_get(body, "$.records", "variant")
    # The list test sits in a projection: as a filter it would be pushed below and parse again.
    is_list = F.schema_of_variant("listed").startswith("ARRAY")
    elements = (
        messages.select(*keep, listed.alias("listed"))
        .withColumn("listed", F.when(is_list, F.col("listed")))
        .lateralJoin(_variant_rows(messages.sparkSession))
        .filter(F.schema_of_variant("element").startswith("OBJECT"))
    )
    stamp = F.try_variant_get("element", "$.timestamp", "variant")
    text = F.when(F.schema_of_variant(stamp) == "STRING", F.try_variant_get("element", "$.timestamp", "string"))
    return elements.filter(stamp.isNotNull() & ~F.is_variant_null(stamp)).select(
        *keep,
        F.col("position").cast("long").alias("position"),
        F.try_to_timestamp(text).alias("stamp"),
        F.explode(F.col("element").cast("map<string,variant>")).alias("tag", "raw"),
    )


def _variant_rows(spark) -> DataFrame:
    return spark.tvf.variant_explode(F.col("listed").outer()).select(
        F.col("pos").alias("position"), F.col("value").alias("element")
    )


def reading_value(raw: Column) -> Column:
    """Number held by a JSON value: true/false count as 1/0; null and other text as missing."""
    return F.try_variant_get(raw, "$", "double")


def tag_lookup(config: DataFrame) -> DataFrame:
    """(topic, equipment, tag) rows of a config table: one per topic and configured tag."""
    return config.select("equipment_id", F.explode("subscribe_topics").alias("topic"), "tags").select(
        "topic", "equipment_id", F.explode(F.array_distinct("tags")).alias("tag")
    )


def route_and_whitelist(entries: DataFrame, config: DataFrame) -> DataFrame:
    """Give each entry its equipment by topic and keep configured tags only."""
    return entries.join(tag_lookup(config), ["topic", "tag"])


def record_time(clock: str, max_skew_s: int | None) -> Column:
    """Time of a record: its stamp, or the time of receipt.

    Ticks run from the first to the last reading, so one absurd stamp would stretch the grid by
    years. With ``max_skew_s`` a stamp further than that from receipt is not believed.
    """
    if clock not in ("event", "arrival"):
        raise ValueError(f"unknown clock {clock!r}")
    if clock == "arrival":
        return F.col("received_at")
    stamp = F.col("stamp")
    if max_skew_s is not None:
        skew = F.abs(F.unix_micros("stamp") - F.unix_micros("received_at"))
        stamp = F.when(skew <= max_skew_s * 1_000_000, stamp)
    return F.coalesce(stamp, F.col("received_at"))


def parse_records(
    messages: DataFrame, config: DataFrame, clock: str = "event", max_skew_s: int | None = None
) -> DataFrame:
    """Messages to ``readings(equipment_id, tag, ts, value, ord)``.

    A stamp that cannot be read falls back to the time of receipt; ``clock="arrival"`` uses
    receipt throughout. A null value is kept: it overwrites the tag's former value downstream.
    """
    routed = route_and_whitelist(record_entries(messages), config)
    return routed.select(
        "equipment_id",
        "tag",
        record_time(clock, max_skew_s).alias("ts"),
        reading_value(F.col("raw")).alias("value"),
        F.struct("received_at", "offset", "position").alias("ord"),
    )


def parse_commands(commands: DataFrame) -> DataFrame:
    """Keep valid command messages, with their word."""
    return commands.withColumn("command", parse_command(F.col("payload"))).filter(F.col("command").isNotNull())


def config_rows(config: DataFrame) -> DataFrame:
    """Check equipment settings; ``reasons`` lists every rule a row breaks."""

    def required(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.lit(f"{name} is missing"))

    def filled_list(name: str) -> Column:
        return F.when(F.col(name).isNotNull() & (F.size(name) == 0), F.lit(f"{name} is empty"))

    def positive(name: str) -> Column:
        return F.when(F.col(name) <= 0, F.lit(f"{name} is not positive"))

    fields = (
        "equipment_id", "subscribe_topics", "publish_topic", "command_topic", "tags",
        "resample_interval_ms", "window_size", "max_duration", "min_samples",
    )
    duration = parse_duration(F.col("max_duration"))
    rules = [
        *[required(f) for f in fields],
        filled_list("subscribe_topics"),
        filled_list("tags"),
        positive("resample_interval_ms"),
        positive("window_size"),
        positive("min_samples"),
        F.when(F.col("max_duration").isNotNull() & duration.isNull(), F.lit("max_duration is no duration")),
    ]
    reasons = F.array_compact(F.array(*rules))
    return (
        config.withColumn("max_duration_s", duration)
        .withColumn("reasons", reasons)
        .withColumn("valid", F.size("reasons") == 0)
    )
