"""Value scaling used by dials, bars and chart lanes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fraction_of_range(value: Column, low: Column, high: Column) -> Column:
    """Position of ``value`` within [low, high], clamped to 0..1; null where the range is empty."""
    place = F.try_divide(value - low, high - low)
    return F.when(place.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)))


def lane_position(value: Column, low: Column, high: Column) -> Column:
    """Position within a series' own span; a flat series counts as span 1."""
    span = F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    return (value - low) / span


def half_up(value: Column) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(value + F.lit(0.5))
