"""The live board: folds of one-second rollups and alerts into current state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tachyline.functions.scaling import fraction_of_range, half_up, lane_position
from tachyline.functions.time import at, interval
from tachyline.operators.alerts import ALERT_COLUMNS, active_breach
from tachyline.operators.rollups import of_length
from tachyline.plans.sizing import broadcast_if_small
from tachyline.schemas import SERIES

SIGNAL_SENSOR = "speed"


def session_stats(rollups: DataFrame) -> DataFrame:
    """Peak, sample-weighted mean and sample count per series since the start."""
    return rollups.groupBy(*SERIES).agg(
        F.max("maximum").alias("peak"),
        (F.sum(F.col("average") * F.col("count")) / F.sum("count")).alias("mean"),
        F.sum("count").alias("samples"),
    )


def latest_reading(rollups: DataFrame, arrival: str = "window_end") -> DataFrame:
    """The last one-second rollup of each series by arrival."""
    # One max_by per fixed-width column keeps this a HashAggregate; a struct would
    # force a sort-based aggregation.
    kept = [name for name in ("window_start", "count", "average", "minimum", "maximum") if name != arrival]
    return of_length(rollups).groupBy(*SERIES).agg(
        *[F.max_by(name, arrival).alias(name) for name in kept], F.max(arrival).alias(arrival)
    )


def live_signal(
    rollups: DataFrame, now: str | dt.datetime, stale_after: str = "6 seconds", arrival: str = "window_end"
) -> DataFrame:
    """Per car: when its speed was last seen and whether that is recent enough."""
    seen = rollups.groupBy("car_id").agg(
        F.max(F.when(F.col("sensor_id") == SIGNAL_SENSOR, F.col(arrival))).alias("last_seen")
    )
    return seen.withColumn("has_signal", _fresh(seen, "last_seen", now, stale_after))


def _fresh(frame: DataFrame, column: str, now: str | dt.datetime, limit: str) -> Column:
    return F.coalesce(F.col(column) + interval(limit) >= at(frame, column, now), F.lit(False))


#: Instruments of the board that show a channel's current average, and those that show its peak.
CURRENT = {
    "speed": "speed", "engine_rpm": "engine-rpm", "gear": "gear", "throttle": "throttle-position", "brake": "brake-pressure"
}
PEAKS = {"top_speed": "speed", "brake_fl_peak": "brake-temperature-front-left"}


def board_states(rollups: DataFrame, arrival: str = "window_end") -> DataFrame:
    """One row of partial states per car, from one-second rollups.

    A single aggregation; each instrument is a conditional aggregate, so no pivot pass and no
    per-sensor join is needed. ``merged_board`` adds such rows up.
    """
    seconds, is_speed = of_length(rollups), F.col("sensor_id") == SIGNAL_SENSOR
    states = []
    for name, sensor in CURRENT.items():
        mine = F.col("sensor_id") == sensor
        states += [
            F.max_by(F.when(mine, F.col("average")), F.when(mine, F.col(arrival))).alias(name),
            F.max(F.when(mine, F.col(arrival))).alias(f"{name}_at"),
        ]
    for name, sensor in PEAKS.items():
        states.append(F.max(F.when(F.col("sensor_id") == sensor, F.col("maximum"))).alias(name))
    return seconds.groupBy("car_id").agg(
        *states,
        F.sum(F.when(is_speed, F.col("average") * F.col("count"))).alias("speed_total"),
        F.sum(F.when(is_speed, F.col("count"))).alias("speed_count"),
    )


def merged_board(states: DataFrame) -> DataFrame:
    """One row per car from several."""
    merged = []
    for name in CURRENT:
        merged += [F.max_by(name, f"{name}_at").alias(name), F.max(f"{name}_at").alias(f"{name}_at")]
    merged += [F.max(name).alias(name) for name in PEAKS]
    merged += [F.sum(name).alias(name) for name in ("speed_total", "speed_count")]
    return states.groupBy("car_id").agg(*merged)


def last_alert(alerts: DataFrame, arrival: str = "window_end") -> DataFrame:
    """Each car's last alert; of such rows again the last."""
    row = F.struct(*[name for name in dict.fromkeys([arrival, "window_start", "sensor_id", "threshold", *ALERT_COLUMNS]) if name != "car_id"])
    return alerts.groupBy("car_id").agg(F.max(row).alias("_last")).select("car_id", "_last.*")


def finished_board(states: DataFrame, alerts: DataFrame, now: str | dt.datetime, arrival: str = "window_end") -> DataFrame:
    """The board at ``now`` from partial states and alerts."""
    breaches = active_breach(alerts, now, arrival=arrival).select(
        "car_id",
        F.col("sensor_id").alias("breach_sensor"),
        F.col("observed_maximum").alias("breach_observed"),
        F.col("threshold").alias("breach_threshold"),
    )
    cards = states.select(
        "car_id", "speed", "engine_rpm", half_up(F.col("gear")).alias("gear"), "throttle", "brake",
        (F.col("speed_total") / F.col("speed_count")).alias("average_speed"), *PEAKS,
        _fresh(states, "speed_at", now, "6 seconds").alias("has_signal"),
    )
    return cards.join(breaches, "car_id", "left")


def live_board(
    rollups: DataFrame, alerts: DataFrame, now: str | dt.datetime, arrival: str = "window_end"
) -> DataFrame:
    """One row per car: instruments, session facts, signal state and held breach."""
    return finished_board(board_states(rollups, arrival), alerts, now, arrival)


def other_cars(rollups: DataFrame, garage: Sequence[str], arrival: str = "window_end") -> DataFrame:
    """Cars outside the garage with their current speed, sorted by id."""
    others = of_length(rollups)
    if garage:
        others = others.filter(~F.col("car_id").isin(list(garage)))
    is_speed = F.col("sensor_id") == SIGNAL_SENSOR
    speed = F.max_by(F.when(is_speed, F.col("average")), F.when(is_speed, F.col(arrival)))
    return others.groupBy("car_id").agg(speed.alias("speed")).orderBy("car_id")


def channel_context(rows: DataFrame, catalogue: DataFrame, value: str = "average") -> DataFrame:
    """Rows with their channel's unit and range, and the clamped fraction of it.

    Channels missing from the catalogue keep their rows with null context.
    """
    context = broadcast_if_small(
        catalogue.select("sensor_id", "unit", "minimum_value", "maximum_value")
    )
    fraction = fraction_of_range(F.col(value), F.col("minimum_value"), F.col("maximum_value"))
    return rows.join(context, "sensor_id", "left").withColumn(
        "fraction", F.when(F.col("maximum_value").isNotNull(), fraction)
    )


def lane_scale(rollups: DataFrame) -> DataFrame:
    """Each average placed within its own series' lowest and highest average.

    The spans are a separate, map-side combined aggregation joined back, so no
    series has to fit in one task; adaptive execution broadcasts them when small.
    """
    spans = rollups.groupBy(*SERIES).agg(F.min("average").alias("low"), F.max("average").alias("high"))
    return rollups.join(spans, SERIES).withColumn(
        "lane", lane_position(F.col("average"), F.col("low"), F.col("high"))
    )
