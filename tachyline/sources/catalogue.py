"""The channel catalogue and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tachyline.schemas import (
    BASE_CHANNELS,
    SENSOR_DEFINITION,
    SYNTHETIC_RATES,
    SYNTHETIC_SHAPES,
    small_table,
)


def validate_load(cars: int, sensors: int, scale: float) -> None:
    """Limits of a load setting: 1..200 cars, 1..2000 sensors, scale 0.01..100."""
    if not 1 <= cars <= 200:
        raise ValueError("cars must be between 1 and 200")
    if not 1 <= sensors <= 2000:
        raise ValueError("sensors must be between 1 and 2000")
    if not 0.01 <= scale <= 100.0:
        raise ValueError("rate scale must be between 0.01 and 100")


def validate_burst(multiplier: float, duration_seconds: int) -> None:
    """Limits of a burst: multiplier 1..50 for 1..600 seconds."""
    if not 1.0 <= multiplier <= 50.0:
        raise ValueError("burst multiplier must be between 1 and 50")
    if not 1 <= duration_seconds <= 600:
        raise ValueError("burst duration must be between 1 and 600 seconds")


def sensor_catalogue(spark: SparkSession, count: int = len(BASE_CHANNELS)) -> DataFrame:
    """The first ``count`` channels: named ones, then generated padding channels."""
    if count < 1:
        raise ValueError("a catalogue has at least one channel")
    named = small_table(spark, BASE_CHANNELS[:count], SENSOR_DEFINITION)
    if count <= len(BASE_CHANNELS):
        return named
    rates = F.array(*[F.lit(rate) for rate in SYNTHETIC_RATES])
    shapes = F.array(*[F.lit(shape) for shape in SYNTHETIC_SHAPES])
    k = F.col("id").cast("int")
    synthetic = spark.range(count - len(BASE_CHANNELS)).select(
        F.format_string("aux-channel-%03d", "id").alias("sensor_id"),
        F.lit("unit").alias("unit"),
        F.lit(0.0).alias("minimum_value"),
        F.lit(100.0).alias("maximum_value"),
        F.element_at(rates, k % len(SYNTHETIC_RATES) + 1).alias("rate_hz"),
        F.element_at(shapes, k % len(SYNTHETIC_SHAPES) + 1).alias("shape"),
    )
    return named.unionByName(synthetic)


def scale_rate(catalogue: DataFrame, scale: float, burst: float = 1.0) -> DataFrame:
    """The catalogue with each channel's effective rate and sampling period.

    The period is whole nanoseconds and never below one microsecond.
    """
    factor = scale * burst
    period = (F.floor(F.lit(1_000_000_000) / F.col("rate_hz")) / F.lit(float(factor))).cast("bigint")
    return catalogue.withColumn("effective_rate_hz", F.col("rate_hz") * F.lit(float(factor))).withColumn(
        "period_ns", F.greatest(period, F.lit(1000).cast("bigint"))
    )


def target_rate(catalogue: DataFrame, cars: int, scale: float = 1.0) -> DataFrame:
    """Readings per second that this many cars make at a rate scale."""
    return catalogue.agg(
        F.floor(F.lit(float(scale)) * cars * F.sum("rate_hz") + 0.5).alias("target_events_per_second")
    )
