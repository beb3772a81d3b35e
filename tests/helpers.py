"""Small inputs for the tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

W = dt.datetime(2026, 8, 23, 12, 0, 0)


def readings(spark, rows):
    """rows: (car, sensor, seconds after W, value); arrival and sequence by position."""
    data = [
        (car, sensor, (W + dt.timedelta(seconds=at)).isoformat(sep=" "), float(value), n, n)
        for n, (car, sensor, at, value) in enumerate(rows)
    ]
    frame = spark.createDataFrame(
        data, "car_id string, sensor_id string, t string, value double, sequence_no bigint, arrival bigint"
    )
    return frame.select(
        "car_id", "sensor_id", F.col("t").cast("timestamp").alias("event_time"), "value", "sequence_no", "arrival"
    )


def tick(at):
    return ("CAR-99", "speed", at, 0.0)


def speed(at, value):
    return ("CAR-01", "speed", at, value)


def values(frame, *columns, order=None):
    rows = frame.select(*columns).orderBy(*(order or columns)).collect()
    return [tuple(row) if len(columns) > 1 else row[0] for row in rows]


def formatted_plan(frame):
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)
