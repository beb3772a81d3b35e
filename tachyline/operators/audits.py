"""Data-quality and traffic audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tachyline.functions.time import interval, micros, time_bucket
from tachyline.plans.blocked import BLOCK_ROWS, by_position, by_time, position, previous, running_max, trailing_sum
from tachyline.schemas import SERIES


def late_audit(
    events: DataFrame,
    grace: str,
    window: str = "1 second",
    partition: Sequence[str] = (),
    arrival: str = "arrival",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mark each reading late or not, by the exact per-record rule.

    Stream time is the highest event time that has arrived so far in the reading's
    partition; a reading is late when its window's end is at or before stream time
    less the grace period. ``arrival`` is a unique integer within a partition.
    """
    timed = running_max(
        events, list(partition), arrival, "event_time", "stream_time", by_position(arrival, block_rows)
    )
    window_end = time_bucket(window, "event_time") + interval(window)
    return timed.withColumn("window_end", window_end).withColumn(
        "late", F.col("window_end") <= F.col("stream_time") - interval(grace)
    ).withColumn("lateness_us", micros("stream_time") - micros("event_time"))


def late_summary(audited: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Readings, late ones among them and the worst lateness in seconds."""
    return audited.groupBy(*by).agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_if("late").alias("late_readings"),
        (F.max("lateness_us") / 1e6).alias("worst_lateness_s"),
    )


def sequence_gaps(events: DataFrame, block: str = "1 hour") -> DataFrame:
    """Missing sequence ranges per series in event-time order, and restarts.

    A jump of more than one is a gap; a decrease is a restart of the counter.
    """
    steps = previous(events, SERIES, "event_time", {"sequence_no": "previous_no"}, by_time("event_time", block))
    step = F.col("sequence_no") - F.col("previous_no")
    return (
        steps.filter((step > 1) | (step < 0))
        .withColumn("kind", F.when(step > 1, "gap").otherwise("restart"))
        .withColumn("missing", F.when(step > 1, step - 1).otherwise(F.lit(0)).cast("bigint"))
        .select(*SERIES, "event_time", "previous_no", "sequence_no", "kind", "missing")
    )


def systematic_sample(
    events: DataFrame, n: int, arrival: str = "arrival", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every n-th reading of each series in arrival order."""
    n = max(1, n)
    numbered = position(events, SERIES, arrival, "_seen", by_position(arrival, block_rows))
    return numbered.filter(F.col("_seen") % n == 0).drop("_seen")


def count_by_sensor(events: DataFrame, sensor_id: str | None = None) -> DataFrame:
    """Stored readings of one sensor, or of every sensor."""
    chosen = events if sensor_id is None else events.filter(F.col("sensor_id") == sensor_id)
    return chosen.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("readings"))


def car_summary(events: DataFrame) -> DataFrame:
    """Readings and latest event time of each car, by car."""
    return (
        events.groupBy("car_id")
        .agg(F.count(F.lit(1)).alias("readings"), F.max("event_time").alias("latest"))
        .orderBy("car_id")
    )


def events_per_second(events: DataFrame, arrived_at: str = "event_time") -> DataFrame:
    """Readings that arrived in each second."""
    return (
        events.withColumn("second", time_bucket("1 second", arrived_at))
        .groupBy("second")
        .agg(F.count(F.lit(1)).alias("readings"))
    )


def counter_rate(
    samples: DataFrame, labels: Sequence[str], range_seconds: int = 30, block: str = "1 hour"
) -> DataFrame:
    """Per-second increase of cumulative counters over a trailing range.

    ``samples`` holds ``labels..., at, counter``. A drop means the counter restarted,
    so the new value is its increase; a series' first sample has none.
    """
    stepped = previous(samples, list(labels), "at", {"counter": "_before"}, by_time("at", block))
    grown = F.when(
        F.col("counter") >= F.col("_before"), F.col("counter") - F.col("_before")
    ).otherwise(F.col("counter"))
    increase = F.when(F.col("_before").isNull(), F.lit(0)).otherwise(grown)
    summed = trailing_sum(
        stepped.withColumn("_increase", increase), list(labels), "at", "_increase", "_rise", range_seconds
    )
    return summed.withColumn("rate", F.col("_rise") / F.lit(float(range_seconds))).select(
        *labels, "at", "counter", "rate"
    )


def rate_by_label(rates: DataFrame, label: Sequence[str] = ()) -> DataFrame:
    """Rates of all series summed per label and instant."""
    return rates.groupBy(*label, "at").agg(F.sum("rate").alias("rate"))


def consumer_lag(latest: DataFrame, committed: DataFrame) -> DataFrame:
    """Lag per partition from two offset tables (``partition``, ``offset``).

    A partition without a committed offset has not been read at all.
    """
    done = committed.select("partition", F.col("offset").alias("_done"))
    return latest.join(done, "partition", "left").select(
        "partition", (F.col("offset") - F.coalesce(F.col("_done"), F.lit(0))).alias("lag")
    )


def max_lag(lags: DataFrame) -> DataFrame:
    return lags.agg(F.max("lag").alias("max_lag"))


def skew_report(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Traffic per key with its share of the total and its ratio to the mean."""
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("readings"))
    whole = counts.agg(
        F.struct(F.sum("readings").alias("total"), F.avg("readings").alias("mean"))
    ).scalar()
    return counts.withColumn("share", F.col("readings") / whole["total"]).withColumn(
        "to_mean", F.col("readings") / whole["mean"]
    )


def nan_audit(events: DataFrame) -> DataFrame:
    """Readings per sensor whose value is not a number."""
    return events.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.isnan("value")).alias("nan_values")
    )


def ingest_summary(metrics: DataFrame) -> DataFrame:
    """Totals and distributions over the per-batch ingest metrics table."""
    return metrics.agg(
        F.sum("received").alias("received"),
        F.sum("null_records").alias("null_records"),
        F.sum("dead_letters").alias("dead_letters"),
        F.sum("consumed").alias("consumed"),
        F.sum("written").alias("written"),
        F.sum("duplicates").alias("duplicates"),
        F.max("consumed").alias("largest_batch"),
        F.percentile("consumed", 0.5).alias("batch_p50"),
        F.percentile("consumed", 0.95).alias("batch_p95"),
        (F.sum("consumed") / (F.sum("write_ms") / F.lit(1000.0))).alias("consumed_per_second"),
        F.percentile_approx("write_ms", [0.5, 0.95, 0.99]).alias("write_ms_p50_p95_p99"),
    )
