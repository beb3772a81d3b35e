import datetime as dt

import pytest

from helpers import W, formatted_plan, readings, speed, values
from tachyline.operators import ranges, rollups


def minutes(spark, count=5):
    return rollups.rollup_1m(readings(spark, [speed(60 * n, n) for n in range(count)]))


def test_a_cut_range_keeps_the_oldest(spark):
    found = ranges.find_rollups(minutes(spark), "CAR-01", "speed", W, W + dt.timedelta(hours=1), 3)
    assert [row["average"] for row in found.collect()] == [0.0, 1.0, 2.0]
    assert ranges.is_truncated(minutes(spark), "CAR-01", "speed", W, W + dt.timedelta(hours=1), 3)
    assert not ranges.is_truncated(minutes(spark), "CAR-01", "speed", W, W + dt.timedelta(hours=1), 5)


def test_ranges_are_half_open(spark):
    found = ranges.find_rollups(
        minutes(spark), "CAR-01", "speed", W + dt.timedelta(minutes=1), W + dt.timedelta(minutes=3)
    )
    assert [row["average"] for row in found.collect()] == [1.0, 2.0]


def test_nothing_found_can_raise(spark):
    args = (minutes(spark), "CAR-07", "speed", W, W + dt.timedelta(hours=1))
    assert ranges.find_rollups(*args).isEmpty()
    with pytest.raises(ranges.NothingFound):
        ranges.find_rollups(*args, on_empty="raise")


def test_default_range_is_the_last_hour():
    assert ranges.default_range(W) == (W - dt.timedelta(hours=1), W)
    assert ranges.default_range(W, end="2026-08-23T10:00:00Z") == (dt.datetime(2026, 8, 23, 9), dt.datetime(2026, 8, 23, 10))
    assert ranges.default_range("2026-08-23T14:00:00+02:00", start=W) == (W, W)


def test_channels_are_cut_each_and_say_so(spark):
    events = readings(spark, [speed(60 * n, n) for n in range(4)] + [("CAR-01", "gear", 60 * n, n) for n in range(2)])
    found = ranges.find_channels(
        rollups.rollup_1m(events), "CAR-01", ["speed", "gear"], W, W + dt.timedelta(hours=1), 2
    )
    assert values(found, "sensor_id", "average", "truncated") == [
        ("gear", 0.0, False), ("gear", 1.0, False), ("speed", 0.0, True), ("speed", 1.0, True)
    ]
    whole = ranges.find_channels(
        rollups.rollup_1m(events), "CAR-01", ["speed", "gear", *"abcdef"], W, W + dt.timedelta(hours=1)
    )
    assert whole.count() == 6 and whole.filter("truncated").isEmpty()


def test_a_range_is_whole_unless_asked_otherwise(spark):
    rows = minutes(spark)
    args = (rows, "CAR-01", "speed", W, W + dt.timedelta(hours=1))
    assert [row["truncated"] for row in ranges.find_rollups(*args).collect()] == [False] * 5
    assert [row["truncated"] for row in ranges.find_rollups(*args, 5).collect()] == [False] * 5
    assert [row["truncated"] for row in ranges.find_rollups(*args, 4).collect()] == [True] * 4


def test_channel_lists(spark):
    names = spark.createDataFrame([("aux-channel-000",), ("speed",), ("gear",)], "sensor_id string")
    assert [row[0] for row in ranges.channel_order(names).collect()] == ["gear", "speed", "aux-channel-000"]
    assert values(ranges.search_channels(names, " SPE "), "sensor_id") == ["speed"]
    assert values(ranges.cars(minutes(spark)), "car_id") == ["CAR-01"]
    assert values(ranges.sensors(minutes(spark)), "sensor_id") == ["speed"]


def test_only_the_directories_of_a_range_are_read(spark, place):
    from tachyline.plans.ingest import ingest_batch
    from tachyline.plans.lifecycle import backfill
    from tachyline.plans.store import Store

    store = Store(spark, place).create()
    hour = dt.timedelta(hours=1)
    ingest_batch(readings(spark, [speed(3600 * n, n) for n in range(60)]), 0, store)
    backfill(store)
    for first, last in ((0, 3), (5, 40), (11, 13), (59, 90), (70, 80), (3, 3)):
        start, end = W + first * hour, W + last * hour
        found = store.rollups_between("ONE_MINUTE", start, end)
        expected = values(ranges.in_range(store.rollups(), start, end), "bucket")
        assert values(ranges.in_range(found, start, end), "bucket") == expected
        chunks = {row[0] for row in found.select("bucket_date", "bucket_hour").distinct().collect()}
        assert found.count() == len(expected), chunks
        hours = store.rollups_between("ONE_HOUR", start, end)
        assert values(ranges.in_range(hours, start, end), "bucket") == expected


def test_the_range_reaches_the_reader(spark, place):
    from tachyline.plans.lifecycle import backfill
    from tachyline.plans.ingest import ingest_batch
    from tachyline.plans.store import Store

    store = Store(spark, place).create()
    ingest_batch(readings(spark, [speed(60 * n, n) for n in range(4)] + [speed(86400, 9)]), 0, store)
    backfill(store)
    found = ranges.find_rollups(store.rollups(), "CAR-01", "speed", W, W + dt.timedelta(minutes=2))
    plan = formatted_plan(found)
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(bucket" in plan and "EqualTo(car_id" in plan
    assert "bucket_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [row["average"] for row in found.collect()] == [0.0, 1.0]
