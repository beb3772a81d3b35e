import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import W, readings, speed, values
from tachyline.functions.time import ceil_to, floor_to, iso_duration, seconds_of
from tachyline.operators import rollups


def test_one_window_has_count_mean_min_and_max(spark):
    rows = rollups.rollup(readings(spark, [speed(0.1, 200), speed(0.3, 300), speed(0.7, 100)]), "1 second")
    row = rows.first()
    assert (row["count"], row["average"], row["minimum"], row["maximum"]) == (3, 200.0, 100.0, 300.0)
    assert (row["window_start"], row["window_end"]) == (W, W + dt.timedelta(seconds=1))
    assert row["window_length"] == "PT1S"
    assert rows.columns == rollups.LIVE_COLUMNS


def test_hour_mean_is_weighted_by_samples(spark):
    events = readings(spark, [speed(1, 10), speed(61, 20), speed(62, 20), speed(63, 20)])
    hour = rollups.rollup_1h(rollups.rollup_1m(events)).first()
    assert (hour["samples"], hour["average"]) == (4, 17.5)


def test_nan_orders_above_numbers(spark):
    row = rollups.rollup(
        readings(spark, [speed(0.1, float("nan")), speed(0.2, 1), speed(0.3, 2)]), "1 second"
    ).first()
    assert row["minimum"] == 1.0 and math.isnan(row["maximum"]) and math.isnan(row["average"])


def test_a_separator_inside_ids_does_not_merge_series(spark):
    rows = rollups.rollup(readings(spark, [("A|B", "C", 0.1, 1), ("A", "B|C", 0.2, 2)]), "1 second")
    assert values(rows, "car_id", "sensor_id", "count") == [("A", "B|C", 1), ("A|B", "C", 1)]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 200_000), st.integers(-100, 100)), min_size=1, max_size=40))
def test_combined_lengths_equal_separate_rollups(spark, points):
    events = readings(spark, [speed(at / 1000, value) for at, value in points])
    both = rollups.rollup_lengths(events, ["1 second", "1 minute", "90 seconds"])
    apart = (
        rollups.rollup(events, "1 second")
        .unionByName(rollups.rollup(events, "1 minute"))
        .unionByName(rollups.rollup(events, "90 seconds"))
    )
    rounded = F.round("average", 9)
    assert both.withColumn("average", rounded).exceptAll(apart.withColumn("average", rounded)).isEmpty()
    assert both.count() == apart.count()


def test_a_length_that_is_no_multiple_is_rolled_up_from_readings(spark):
    events = readings(spark, [speed(1, 1), speed(2, 2), speed(3, 3)])
    rows = rollups.rollup_lengths(events, ["2 seconds", "3 seconds"])
    assert values(rows, "window_length", "count") == [("PT2S", 1), ("PT2S", 2), ("PT3S", 1), ("PT3S", 2)]


def test_combined_lengths_scan_the_readings_once(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.lit("CAR-01").alias("car_id"), F.col("event_type").alias("sensor_id"),
        F.col("ts").alias("event_time"), "value",
    )
    frame = rollups.rollup_lengths(events)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FileScan") == 1


@pytest.mark.parametrize("text, code", [("1 second", "PT1S"), ("1 minute", "PT1M"), ("90 seconds", "PT1M30S"), ("1 hour", "PT1H")])
def test_iso_durations(text, code):
    assert iso_duration(text) == code


def test_durations_and_bounds():
    assert seconds_of("7 days") == 604800
    with pytest.raises(ValueError):
        seconds_of("soon")
    assert floor_to(dt.datetime(2026, 1, 1, 0, 0, 59), "1 minute") == dt.datetime(2026, 1, 1)
    assert ceil_to(dt.datetime(2026, 1, 1, 0, 0, 1), "1 minute") == dt.datetime(2026, 1, 1, 0, 1)
