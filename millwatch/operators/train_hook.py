"""Bring-your-own model: a caller's functions fit one equipment's calibration samples, bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.operators.buckets import BUCKET, BUCKET_TICKS, add_bucket, spread

Frame = pd.DataFrame
#: Partial results that one merge call gets at most.
FAN_IN = 256


def train_hook(
    samples: DataFrame,
    partial: Callable[[Frame], Frame],
    partial_schema: str,
    merge: Callable[[Frame], Frame],
    finish: Callable[[Frame], Frame],
    schema: str,
    size: int = BUCKET_TICKS,
) -> DataFrame:
    """Fit every equipment to its whole history through three functions of the caller.

    ``partial`` gets one bucket of an equipment's samples in tick order and returns one row of
    ``partial_schema``, which has ``equipment_id``. ``merge`` folds some of these rows, in bucket order, into one row of
    the same schema and must not depend on how they are grouped. ``finish`` turns the last one into
    rows of ``schema``. No call sees more than a bucket of samples or ``FAN_IN`` partial results at a time.
    """

    def per_bucket(group: Frame) -> Frame:
        number = group[BUCKET].iloc[0]
        return partial(group.sort_values("tick", ignore_index=True)).assign(**{BUCKET: number})

    def folded(group: Frame) -> Frame:
        rows, number = group.sort_values(BUCKET, ignore_index=True), group[BUCKET].min()
        while len(rows) > 1:
            parts = [merge(rows.iloc[at : at + FAN_IN].drop(columns=BUCKET)) for at in range(0, len(rows), FAN_IN)]
            rows = pd.concat(parts, ignore_index=True).assign(**{BUCKET: range(len(parts))})
        return rows.assign(**{BUCKET: number})

    def last(group: Frame) -> Frame:
        return finish(folded(group).drop(columns=BUCKET))

    kept = f"{partial_schema}, {BUCKET} long"
    parts = spread(add_bucket(samples, "tick", size), ["equipment_id"]).groupBy("equipment_id", BUCKET).applyInPandas(per_bucket, kept)
    stretch = F.floor(F.col(BUCKET) / F.lit(FAN_IN)).alias("stretch")
    some = parts.groupBy("equipment_id", stretch).applyInPandas(folded, kept)
    return some.groupBy("equipment_id").applyInPandas(last, schema)
