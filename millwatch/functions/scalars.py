"""Column expressions shared by batch and streaming jobs. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds in each duration unit.
DURATION_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

# Tolerance limits of an inspection.
ANGLE_LIMITS = (107.0, 113.0)
ANGLE_MAX_GAP = 2.5
WIDTH_LIMITS = (0.82, 0.92)
WIDTH_MAX_GAP = 0.1
POSITIONS = tuple(f"{p:02d}" for p in range(1, 13))

COMMANDS = ("train", "recalibrate")


def finite_or_null(value: Column) -> Column:
    """NaN to null: Spark sorts NaN above every number, so it must not reach a comparison."""
    return F.when(~F.isnan(value), value)


def floor_div(index: Column, size: int) -> Column:
    """Floor of ``index / size`` as a long; exact for |index| below 2**53."""
    return F.floor(index / F.lit(size))


def tick_of(ts: Column, interval_ms: Column | int) -> Column:
    """Number of the tick that first sees a reading at ``ts``.

    Tick k covers ((k-1)*interval, k*interval], on whole microseconds since the epoch.
    """
    step = (F.lit(interval_ms) if isinstance(interval_ms, int) else interval_ms).cast("long") * 1000
    micros = F.unix_micros(ts.cast("timestamp"))
    over = F.pmod(micros, step)
    return ((micros - over) / step).cast("long") + (over > 0).cast("long")


def stripped(text: Column) -> Column:
    """Text without white space (line ends included) around it."""
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


def parse_duration(text: Column) -> Column:
    """``'7d' '12h' '30m' '45s'`` as seconds; null for anything else."""
    trimmed = stripped(text)
    amount = F.regexp_extract(trimmed, r"^(\d+)([smhd])$", 1).try_cast("long")
    unit = F.regexp_extract(trimmed, r"^(\d+)([smhd])$", 2)
    seconds = F.create_map(*[F.lit(x) for kv in DURATION_UNIT_SECONDS.items() for x in kv])
    return F.when(unit != "", amount * F.get(F.map_values(F.map_filter(seconds, lambda k, _: k == unit)), F.lit(0)))


def parse_command(payload: Column) -> Column:
    """Command word held by a message payload, or null when it is not a known command."""
    body = F.try_parse_json(F.try_validate_utf8(payload.cast("string")))
    word = F.try_variant_get(body, "$.command", "string")
    is_text = F.schema_of_variant(F.try_variant_get(body, "$.command", "variant")) == "STRING"
    return F.when(is_text & word.isin(*COMMANDS), word)


def inspection_time(date: Column, time: Column) -> Column:
    """``yyyyMMdd`` date and ``HHmmss`` time (leading zeros optional) as a timestamp, else null."""
    text = time.cast("string")
    # lpad would cut longer text, so only short text is filled.
    filled = F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)
    return F.try_to_timestamp(F.concat(date.cast("string"), filled), F.lit("yyyyMMddHHmmss"))


def out_of_tolerance(measure) -> Column:
    """1 unless every position is within its limits. ``measure(name)`` gives the scaled column.

    A missing measure makes its comparison null, which counts as out of tolerance.
    """

    def pair_ok(left: str, right: str, limits: tuple[float, float], gap: float) -> Column:
        a, b = measure(left), measure(right)
        low, high = F.lit(limits[0]), F.lit(limits[1])
        return a.between(low, high) & b.between(low, high) & (F.abs(a - b) <= F.lit(gap))

    checks = [
        pair_ok(f"A_L_{p}", f"A_R_{p}", ANGLE_LIMITS, ANGLE_MAX_GAP)
        & pair_ok(f"X_L_{p}", f"X_R_{p}", WIDTH_LIMITS, WIDTH_MAX_GAP)
        for p in POSITIONS
    ]
    return F.when(reduce(lambda x, y: x & y, checks), F.lit(0)).otherwise(F.lit(1))


def floored_std(mean: Column, std: Column) -> Column:
    """Error spread, kept at or above both 1e-3 and 5 % of the mean error."""
    return F.greatest(std, F.lit(1e-3), F.lit(0.05) * F.abs(mean))


def normalized(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def state_or_default(state: Column) -> Column:
    """A stored state word; anything missing or unreadable means CALIBRATING."""
    clean = stripped(state)
    return F.when(clean.isin("CALIBRATING", "MONITORING"), clean).otherwise(F.lit("CALIBRATING"))
