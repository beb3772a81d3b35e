"""Threshold alerts and their history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tachyline.functions.time import at, interval
from tachyline.plans.sizing import broadcast_if_small

ALERT_COLUMNS = ["car_id", "sensor_id", "window_start", "window_end", "observed_maximum", "threshold"]


def alerts_for(rollups: DataFrame, rules: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One alert per rollup and rule of its sensor whose maximum is exceeded.

    Strictly greater; a window that holds a NaN raises nothing. Works on a stream,
    since the rules side is static. ``carry`` names further rollup columns to keep.
    """
    limits = broadcast_if_small(
        rules.select(F.col("sensor_id").alias("_sensor"), F.col("maximum").alias("threshold"))
    )
    breach = (
        (F.col("sensor_id") == F.col("_sensor"))
        & (F.col("maximum") > F.col("threshold"))
        & ~F.isnan("maximum")
    )
    return (
        rollups.join(limits, breach, "inner")
        .withColumnRenamed("maximum", "observed_maximum")
        .select(*ALERT_COLUMNS, *carry)
    )


def recent_alerts(alerts: DataFrame, n: int, arrival: str = "window_end") -> DataFrame:
    """The ``n`` newest alerts, newest first by arrival; other columns break ties."""
    return alerts.orderBy(
        F.col(arrival).desc(), "car_id", "sensor_id", "window_start", "threshold"
    ).limit(n)


def latest_breach(alerts: DataFrame, arrival: str = "window_end") -> DataFrame:
    """The last alert of each car with its excess over the threshold."""
    last = F.max_by(
        F.struct("sensor_id", "observed_maximum", "threshold"),
        F.struct(arrival, "window_start", "sensor_id", "threshold"),
    )
    return (
        alerts.groupBy("car_id")
        .agg(last.alias("_last"), F.max(arrival).alias("at"))
        .select(
            "car_id",
            F.col("_last.sensor_id").alias("sensor_id"),
            F.col("_last.observed_maximum").alias("observed_maximum"),
            F.col("_last.threshold").alias("threshold"),
            (F.col("_last.observed_maximum") - F.col("_last.threshold")).alias("excess"),
            "at",
        )
    )


def active_breach(
    alerts: DataFrame, now: str | dt.datetime, hold: str = "30 seconds", arrival: str = "window_end"
) -> DataFrame:
    """Each car's last alert while it is at most ``hold`` old at ``now``."""
    breaches = latest_breach(alerts, arrival)
    return breaches.filter(F.col("at") + interval(hold) >= at(breaches, "at", now))


def alerts_fired(alerts: DataFrame) -> DataFrame:
    """How many alerts each sensor raised."""
    return alerts.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("alerts"))
