"""Row schemas, the shipped alert rules and the channel catalogue."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

KEY = ["car_id", "sensor_id", "event_time"]
SERIES = ["car_id", "sensor_id"]

RAW_RECORD = "key string, value binary, partition int, offset bigint, timestamp timestamp"
LIVE_ROLLUP = (
    "car_id string, sensor_id string, window_length string, window_start timestamp, "
    "window_end timestamp, count bigint, average double, minimum double, maximum double"
)
ALERT_RULE = "sensor_id string, maximum double"
SENSOR_DEFINITION = (
    "sensor_id string, unit string, minimum_value double, maximum_value double, rate_hz int, shape string"
)
INGEST_METRIC = (
    "batch_id bigint, received bigint, null_records bigint, dead_letters bigint, "
    "consumed bigint, written bigint, duplicates bigint, write_ms double"
)

# The alert rules shipped by default (sensor, maximum).
DEFAULT_RULES = [
    ("brake-temperature-front-left", 1050.0),
    ("engine-rpm", 15500.0),
]

# The forty named channels
# (sensor, unit, minimum, maximum, rate in Hz, signal shape).
BASE_CHANNELS = [
    ("speed", "km/h", 0.0, 360.0, 100, "LAP_CORRELATED"),
    ("engine-rpm", "rpm", 4000.0, 15000.0, 200, "LAP_CORRELATED"),
    ("throttle-position", "%", 0.0, 100.0, 100, "LAP_CORRELATED"),
    ("brake-pressure", "bar", 0.0, 140.0, 200, "SPIKY"),
    ("steering-angle", "deg", -360.0, 360.0, 100, "LAP_CORRELATED"),
    ("gear", "ratio", 1.0, 8.0, 50, "LAP_CORRELATED"),
    ("drs-state", "state", 0.0, 1.0, 10, "SPIKY"),
    ("lateral-acceleration", "g", -6.0, 6.0, 200, "LAP_CORRELATED"),
    ("longitudinal-acceleration", "g", -6.0, 6.0, 200, "LAP_CORRELATED"),
    ("vertical-acceleration", "g", -8.0, 8.0, 500, "SPIKY"),
    ("tyre-temperature-front-left", "C", 60.0, 130.0, 5, "STEADY"),
    ("tyre-temperature-front-right", "C", 60.0, 130.0, 5, "STEADY"),
    ("tyre-temperature-rear-left", "C", 60.0, 130.0, 5, "STEADY"),
    ("tyre-temperature-rear-right", "C", 60.0, 130.0, 5, "STEADY"),
    ("tyre-pressure-front-left", "psi", 18.0, 26.0, 5, "STEADY"),
    ("tyre-pressure-front-right", "psi", 18.0, 26.0, 5, "STEADY"),
    ("tyre-pressure-rear-left", "psi", 18.0, 26.0, 5, "STEADY"),
    ("tyre-pressure-rear-right", "psi", 18.0, 26.0, 5, "STEADY"),
    ("brake-temperature-front-left", "C", 200.0, 1000.0, 20, "LAP_CORRELATED"),
    ("brake-temperature-front-right", "C", 200.0, 1000.0, 20, "LAP_CORRELATED"),
    ("brake-temperature-rear-left", "C", 200.0, 1000.0, 20, "LAP_CORRELATED"),
    ("brake-temperature-rear-right", "C", 200.0, 1000.0, 20, "LAP_CORRELATED"),
    ("damper-travel-front-left", "mm", -30.0, 30.0, 500, "SPIKY"),
    ("damper-travel-front-right", "mm", -30.0, 30.0, 500, "SPIKY"),
    ("damper-travel-rear-left", "mm", -30.0, 30.0, 500, "SPIKY"),
    ("damper-travel-rear-right", "mm", -30.0, 30.0, 500, "SPIKY"),
    ("oil-temperature", "C", 80.0, 140.0, 2, "STEADY"),
    ("oil-pressure", "bar", 2.0, 8.0, 10, "STEADY"),
    ("water-temperature", "C", 70.0, 120.0, 2, "STEADY"),
    ("fuel-flow", "kg/h", 0.0, 100.0, 50, "LAP_CORRELATED"),
    ("fuel-remaining", "kg", 0.0, 110.0, 1, "STEADY"),
    ("energy-store-charge", "%", 0.0, 100.0, 20, "LAP_CORRELATED"),
    ("energy-store-temperature", "C", 30.0, 70.0, 5, "STEADY"),
    ("mgu-k-power", "kW", -120.0, 120.0, 100, "LAP_CORRELATED"),
    ("mgu-h-rpm", "rpm", 0.0, 125000.0, 100, "LAP_CORRELATED"),
    ("turbo-pressure", "bar", 1.0, 5.0, 100, "LAP_CORRELATED"),
    ("exhaust-temperature", "C", 400.0, 1000.0, 20, "LAP_CORRELATED"),
    ("gearbox-oil-temperature", "C", 80.0, 150.0, 2, "STEADY"),
    ("chassis-vibration", "g", 0.0, 20.0, 1000, "SPIKY"),
    ("ride-height-front", "mm", 10.0, 60.0, 200, "SPIKY"),
]

# Rates and shapes that synthetic channels cycle through.
SYNTHETIC_RATES = [1, 5, 10, 20, 50, 100, 200, 500]
SYNTHETIC_SHAPES = ["STEADY", "LAP_CORRELATED", "SPIKY"]

# The channels of the dense benchmark series, in seed order.
SEED_CHANNELS = [
    "speed", "engine-rpm", "throttle-position", "brake-pressure", "steering-angle", "gear",
    "lateral-acceleration", "longitudinal-acceleration", "vertical-acceleration",
    "tyre-temperature-front-left", "tyre-temperature-front-right",
    "tyre-temperature-rear-left", "tyre-temperature-rear-right",
    "tyre-pressure-front-left", "tyre-pressure-front-right",
    "brake-temperature-front-left", "brake-temperature-front-right",
    "brake-temperature-rear-left", "brake-temperature-rear-right",
    "damper-travel-front-left", "damper-travel-front-right",
    "oil-temperature", "water-temperature", "fuel-flow", "energy-store-charge",
]


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows held by the driver, as a local relation of known size.

    A Python list would become an RDD of unknown size and would need Python workers to
    be read; Arrow data this small becomes a local relation that Catalyst can measure.
    """
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32()}
    fields = [field.strip().split(" ") for field in ddl.split(",")]
    schema = pa.schema([(name, types[kind]) for name, kind in fields])
    columns = [pa.array([row[at] for row in rows], field.type) for at, field in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def alert_rules(spark: SparkSession, rules: list[tuple[str, float]] | None = None) -> DataFrame:
    """Rules as (sensor_id, maximum); several rules may name one sensor."""
    return small_table(spark, DEFAULT_RULES if rules is None else rules, ALERT_RULE)
