"""Tumbling event-time rollups: live form, stored form and the hierarchy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tachyline.functions.time import interval, iso_duration, seconds_of, time_bucket
from tachyline.schemas import SERIES

LIVE_COLUMNS = [
    "car_id", "sensor_id", "window_length", "window_start", "window_end",
    "count", "average", "minimum", "maximum",
]


def _stats(count_name: str) -> list[Column]:
    # Only fixed-width aggregation buffers, so the plan is a codegen HashAggregate
    # with a map-side partial step; a hot series collapses before the shuffle.
    return [
        F.count(F.lit(1)).alias(count_name),
        F.avg("value").alias("average"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    ]


def weighted_mean(average: str, samples: str) -> Column:
    """Mean of means weighted by how many samples each one stands for."""
    return F.sum(F.col(average) * F.col(samples)) / F.sum(samples)


def rollup(events: DataFrame, window: str) -> DataFrame:
    """Live rollup: one row per car, sensor and window of length ``window``.

    On a stream give ``events`` a watermark first; in append mode each window then
    comes out once, when it closes.
    """
    if events.isStreaming:
        grouped = events.groupBy(*SERIES, F.window("event_time", window).alias("_w")).agg(*_stats("count"))
        start, end = F.col("_w.start"), F.col("_w.end")
    else:
        # Grouping on the start alone halves the time part of the key.
        grouped = (
            events.withColumn("_start", time_bucket(window, "event_time"))
            .groupBy(*SERIES, "_start")
            .agg(*_stats("count"))
        )
        start, end = F.col("_start"), F.col("_start") + interval(window)
    return grouped.select(
        *SERIES,
        F.lit(iso_duration(window)).alias("window_length"),
        start.alias("window_start"),
        end.alias("window_end"),
        "count", "average", "minimum", "maximum",
    )


def rollup_lengths(events: DataFrame, windows: Sequence[str] = ("1 second", "1 minute")) -> DataFrame:
    """All window lengths in one frame (batch), reading the source once.

    The shortest window is aggregated from the readings; a longer one that is a
    multiple of it adds up the shortest windows' counts and sums. Both branches
    start from the same exchange, which Spark reuses. A length that is not a
    multiple is aggregated from the readings.
    """
    shortest = min(windows, key=seconds_of)
    # The coarser bucket below implies that _start is not null. Saying so here as well
    # keeps the plans of both branches equal down to the scan, or Spark would not see
    # that they share an exchange.
    base = (
        events.withColumn("_start", time_bucket(shortest, "event_time"))
        .filter(F.col("_start").isNotNull())
        .groupBy(*SERIES, "_start")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("value").alias("_total"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
        )
    )
    frames = []
    for window in windows:
        if seconds_of(window) % seconds_of(shortest):
            frames.append(rollup(events, window))
            continue
        sums = base
        if window != shortest:
            sums = (
                base.withColumn("_start", time_bucket(window, "_start"))
                .groupBy(*SERIES, "_start")
                .agg(
                    F.sum("count").alias("count"),
                    F.sum("_total").alias("_total"),
                    F.min("minimum").alias("minimum"),
                    F.max("maximum").alias("maximum"),
                )
            )
        frames.append(
            sums.select(
                *SERIES,
                F.lit(iso_duration(window)).alias("window_length"),
                F.col("_start").alias("window_start"),
                (F.col("_start") + interval(window)).alias("window_end"),
                "count",
                (F.col("_total") / F.col("count")).alias("average"),
                "minimum",
                "maximum",
            )
        )
    return reduce(DataFrame.unionByName, frames)


def rollup_1m(events: DataFrame) -> DataFrame:
    """Stored one-minute aggregate of readings."""
    return (
        events.withColumn("bucket", time_bucket("1 minute", "event_time"))
        .groupBy(*SERIES, "bucket")
        .agg(*_stats("samples"))
    )


def minute_states(events: DataFrame) -> DataFrame:
    """Partial states of the one-minute aggregate: what readings that come later can be added to."""
    return (
        events.withColumn("bucket", time_bucket("1 minute", "event_time"))
        .groupBy(*SERIES, "bucket")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.sum("value").alias("total"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
        )
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One partial state per series and bucket."""
    return states.groupBy(*SERIES, "bucket").agg(
        F.sum("samples").alias("samples"),
        F.sum("total").alias("total"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
    )


def finished(states: DataFrame) -> DataFrame:
    """The stored one-minute rows of merged states."""
    return states.select(
        *SERIES, "bucket", "samples", (F.col("total") / F.col("samples")).alias("average"), "minimum", "maximum"
    )


def rollup_1h(minutes: DataFrame) -> DataFrame:
    """Stored one-hour aggregate, built from one-minute rows, never from readings."""
    return (
        minutes.withColumn("bucket", time_bucket("1 hour", "bucket"))
        .groupBy(*SERIES, "bucket")
        .agg(
            weighted_mean("average", "samples").alias("average"),
            F.sum("samples").alias("samples"),
            F.min("minimum").alias("minimum"),
            F.max("maximum").alias("maximum"),
        )
        .select(*SERIES, "bucket", "samples", "average", "minimum", "maximum")
    )


def of_length(rollups: DataFrame, window: str = "1 second") -> DataFrame:
    """Live rollups of one window length; the live board uses one second."""
    return rollups.filter(F.col("window_length") == iso_duration(window))


def rollups_emitted(rollups: DataFrame) -> DataFrame:
    """How many rollups each window length produced."""
    return rollups.groupBy("window_length").agg(F.count(F.lit(1)).alias("rollups"))
