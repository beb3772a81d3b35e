"""Readings from the driver's event table, and the dense benchmark series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tachyline.functions.time import instant
from tachyline.schemas import BASE_CHANNELS, SEED_CHANNELS

TICK_MS = 30
SEED_EPOCH = "2024-01-01 00:00:00"


def car_label(number: Column) -> Column:
    return F.format_string("CAR-%02d", number.cast("bigint"))


def _ranges(names: list[str]) -> Column:
    """An array literal of (sensor_id, low, high) for the named channels."""
    known = {name: (low, high) for name, _, low, high, _, _ in BASE_CHANNELS}
    entries = [
        f"named_struct('sensor_id', '{name}', 'low', {known[name][0]}D, 'high', {known[name][1]}D)"
        for name in names
    ]
    return F.expr(f"array({', '.join(entries)})")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as readings: five cars, the event type as the sensor."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        car_label(F.col("user_id") % 5 + 1).alias("car_id"),
        F.col("event_type").alias("sensor_id"),
        F.col("ts").alias("event_time"),
        "value",
        F.col("event_id").alias("sequence_no"),
        F.col("event_id").alias("arrival"),
    )


def channel_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as dense readings of the forty named channels.

    Event n becomes tick n of a 30 ms clock on channel n mod 40; its value is spread
    over the channel's range, with the top of the distribution beyond the range, so
    that the shipped alert rules have something to find. No value is clamped.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    channels = _ranges([name for name, *_ in BASE_CHANNELS])
    channel = F.element_at(channels, (F.col("event_id") % len(BASE_CHANNELS) + 1).cast("int"))
    fraction = F.col("value") / F.lit(207.0)
    return events.select(
        car_label(F.col("user_id") % 5 + 1).alias("car_id"),
        channel["sensor_id"].alias("sensor_id"),
        tick_time(F.col("event_id")).alias("event_time"),
        (channel["low"] + (channel["high"] - channel["low"]) * fraction).alias("value"),
        F.col("event_id").alias("sequence_no"),
        F.col("event_id").alias("arrival"),
    )


def tick_time(tick: Column, start: str | dt.datetime = SEED_EPOCH) -> Column:
    """Zone-less time of a tick of the 30 ms clock."""
    origin = F.lit(instant(start).isoformat(sep=" ")).cast("timestamp_ntz")
    return origin + F.expr(f"INTERVAL '0.{TICK_MS:03d}' SECOND") * tick


def dense_values(ticks: DataFrame, start: str | dt.datetime = SEED_EPOCH) -> DataFrame:
    """The 25 benchmark channels for every (car, tick) row.

    ``ticks`` holds ``car bigint, tick bigint``. Each row is expanded in place, so
    there is no join and no shuffle.
    """
    # The benchmark series' own wave.
    wave = F.lit(0.5) + F.lit(0.45) * F.sin(F.col("tick") / F.lit(3000.0) + F.col("car"))
    return ticks.select("car", "tick", wave.alias("wave"), F.inline(_ranges(SEED_CHANNELS))).select(
        car_label(F.col("car")).alias("car_id"),
        "sensor_id",
        tick_time(F.col("tick"), start).alias("event_time"),
        (F.col("low") + (F.col("high") - F.col("low")) * F.col("wave")).alias("value"),
        F.col("tick").alias("sequence_no"),
    )


def seed_series(
    spark: SparkSession,
    cars: int = 5,
    ticks: int = 96_000,
    start: str | dt.datetime = SEED_EPOCH,
    partitions: int | None = None,
) -> DataFrame:
    """The benchmark data set: every car, tick and channel (12 million rows)."""
    clock = spark.range(0, ticks, 1, partitions).withColumnRenamed("id", "tick")
    numbers = F.array(*[F.lit(n).cast("bigint") for n in range(1, cars + 1)])
    return dense_values(clock.select(F.explode(numbers).alias("car"), "tick"), start)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One (car, tick) row per event, for ``dense_values``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        (F.col("user_id") % 5 + 1).alias("car"), F.col("event_id").alias("tick")
    )
