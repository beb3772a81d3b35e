import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from helpers import W, readings, speed, tick, values
from tachyline.operators import audits, dedupe
from tachyline.plans import blocked
from tachyline.sources import catalogue
from tachyline.workload import faults


def at(seconds):
    return W + dt.timedelta(seconds=seconds)


def arrivals(frame):
    return [row["sequence_no"] for row in frame.orderBy("arrival").collect()]


def line(spark, count):
    return readings(spark, [speed(n, n) for n in range(1, count + 1)])


def test_overlap_then_buffer(spark):
    got = faults.dropout_replay(line(spark, 3), at(3), at(4), overlap=10)
    assert arrivals(got) == [0, 1, 0, 1, 2]
    assert got.filter("replayed").count() == 3


def test_a_buffer_is_replayed_once(spark):
    got = faults.dropout_replay(line(spark, 40), at(1), at(41))
    assert arrivals(got) == list(range(40))


def test_a_full_buffer_loses_the_newest(spark):
    events = line(spark, 5)
    got = faults.dropout_replay(events, at(2), at(5), overlap=0, capacity=2)
    assert arrivals(got) == [0, 1, 2, 4]
    assert arrivals(faults.dropped_by_buffer(events, at(2), at(5), 2)) == [3]
    assert arrivals(faults.dropout_replay(events, at(2), at(5), overlap=0, capacity=0)) == [0, 4]
    assert arrivals(faults.dropped_by_buffer(events, at(2), at(5), 0)) == [1, 2, 3]


def test_overlap_keeps_the_newest(spark):
    assert arrivals(faults.last_delivered(line(spark, 3), 3, 2)) == [1, 2]
    assert arrivals(faults.last_delivered(line(spark, 3), 3, 0)) == []
    assert arrivals(faults.last_delivered(line(spark, 3), 3, 9)) == [0, 1, 2]


def test_no_overlap_makes_no_duplicates(spark):
    got = faults.dropout_replay(line(spark, 6), at(3), at(5), overlap=0)
    assert arrivals(got) == list(range(6))


def test_live_traffic_resumes_before_the_replay(spark):
    got = faults.dropout_replay(line(spark, 8), at(3), at(5), overlap=2, replay_at=at(7))
    # delivered 0 1, live 4 5, overlap 4 5, held 2 3, live 6 7
    assert arrivals(got) == [0, 1, 4, 5, 4, 5, 2, 3, 6, 7]
    assert got.select("arrival").distinct().count() == got.count()


def test_nothing_to_hold(spark):
    got = faults.dropout_replay(line(spark, 3), at(100), at(200))
    assert arrivals(got) == [0, 1, 2] and got.filter("replayed").isEmpty()


def test_concatenation_keeps_duplicates(spark):
    assert faults.concatenate(line(spark, 2), line(spark, 3)).count() == 5


def test_an_anomaly_overshoots_by_a_quarter(spark):
    events = readings(spark, [(car, sensor, 1, 500) for car in ("CAR-01", "CAR-02") for sensor in ("brake-temperature-front-left", "engine-rpm")])
    got = faults.inject_anomaly(events, catalogue.sensor_catalogue(spark), "CAR-01", "brake-temperature-front-left")
    assert values(got, "car_id", "sensor_id", "value")[:2] == [
        ("CAR-01", "brake-temperature-front-left", 1200.0), ("CAR-01", "engine-rpm", 500.0),
    ]
    assert got.filter("value = 500").count() == 3
    rpm = faults.inject_anomaly(events, catalogue.sensor_catalogue(spark), "CAR-02", "engine-rpm")
    assert rpm.agg(F.max("value")).first()[0] == 17750.0


CASES = {
    "late within": ([speed(0.1, 200), tick(5), speed(0.9, 400), tick(12)], "10 seconds", []),
    "late after": ([speed(0.1, 200), tick(12), speed(0.9, 400), tick(60)], "10 seconds", [2]),
    "wide grace": ([speed(0.1, 200), tick(11), speed(0.9, 400), tick(62)], "60 seconds", []),
    "boundary": ([speed(0.1, 200), tick(11), speed(0.9, 400)], "10 seconds", [2]),
    "just inside": ([speed(0.1, 200), tick(10.999), speed(0.9, 400)], "10 seconds", []),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block_rows", [1, 2, 1000])
def test_late_audit_follows_the_per_record_rule(spark, name, block_rows):
    rows, grace, late = CASES[name]
    audited = audits.late_audit(readings(spark, rows), grace, block_rows=block_rows)
    assert [row["arrival"] for row in audited.filter("late").collect()] == late


def test_lateness_is_the_worst_distance(spark):
    row = audits.late_summary(audits.late_audit(readings(spark, [tick(12), speed(0.9, 1)]), "10 seconds")).first()
    assert (row["readings"], row["late_readings"], row["worst_lateness_s"]) == (2, 1, 11.1)


POINTS = st.lists(st.tuples(st.sampled_from("abc"), st.integers(-50, 50)), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(POINTS, st.sampled_from([1, 3, 7, 100]))
def test_blocked_scans_equal_plain_windows(spark, points, rows):
    frame = spark.createDataFrame([(k, n * 3, v) for n, (k, v) in enumerate(points)], "k string, o bigint, v bigint")
    plain = Window.partitionBy("k").orderBy("o")
    upto = plain.rowsBetween(Window.unboundedPreceding, 0)
    block = blocked.by_position("o", rows)
    pairs = [
        (blocked.running_max(frame, ["k"], "o", "v", "x", block), F.max("v").over(upto)),
        (blocked.running_sum(frame, ["k"], "o", "v", "x", block), F.sum("v").over(upto)),
        (blocked.position(frame, ["k"], "o", "x", block), F.row_number().over(plain)),
        (blocked.previous(frame, ["k"], "o", {"v": "x"}, block), F.lag("v").over(plain)),
    ]
    for got, expected in pairs:
        assert values(got, "o", "x") == values(frame.withColumn("x", expected), "o", "x")
    count = len(points)
    ordered = [row["o"] for row in frame.orderBy("o").collect()]
    for k in {1, (count + 1) // 2, count}:
        assert blocked.kth_value(frame, "o", k, block_rows=rows) == ordered[k - 1]
        assert blocked.kth_value(frame, "o", k, largest=True, block_rows=rows) == ordered[-k]
    assert blocked.kth_value(frame, "o", count + 1) is None and blocked.kth_value(frame, "o", 0) is None


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 300), min_size=1, max_size=40, unique=True), st.sampled_from([30, 60, 3600]))
def test_trailing_sums_cross_block_edges(spark, times, block_seconds):
    rows = [("a", at(t), t) for t in times]
    frame = spark.createDataFrame(rows, "k string, t timestamp, v bigint")
    got = blocked.trailing_sum(frame, ["k"], "t", "v", "x", 30, block_seconds)
    assert values(got, "t", "x") == sorted((at(t), sum(o for o in times if t - 30 < o <= t)) for t in times)


def test_a_hot_group_is_split_into_blocks(spark):
    audited = audits.late_audit(line(spark, 3), "1 second", partition=["car_id"])
    plan = audited._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [text for text in plan.splitlines() if "Window" in text and "max(event_time" in text]
    assert row_windows and all("_block" in text for text in row_windows)


def test_gaps_and_restarts(spark):
    rows = spark.createDataFrame(
        [("CAR-01", "speed", at(n), 1.0, s) for n, s in enumerate([0, 1, 4, 5, 0, 1])],
        "car_id string, sensor_id string, event_time timestamp, value double, sequence_no bigint",
    )
    for block in ("1 second", "2 seconds", "1 hour"):
        got = values(audits.sequence_gaps(rows, block), "previous_no", "sequence_no", "kind", "missing")
        assert got == [(1, 4, "gap", 2), (5, 0, "restart", 0)]


def test_sample_takes_every_nth_of_each_series(spark):
    events = readings(spark, [(car, "speed", n, n) for n in range(9) for car in ("CAR-01", "CAR-02")])
    got = audits.systematic_sample(events, 3, block_rows=4)
    assert values(got, "car_id", "value") == [(car, float(n)) for car in ("CAR-01", "CAR-02") for n in (2, 5, 8)]
    assert audits.systematic_sample(events, 0).count() == 18


def test_counter_rate_handles_resets(spark):
    samples = spark.createDataFrame(
        [("a", at(10 * n), c) for n, c in enumerate([100, 130, 160, 20, 50])], "k string, at timestamp, counter bigint"
    )
    got = values(audits.counter_rate(samples, ["k"], 30, "20 seconds"), "at", "rate")
    assert [rate for _, rate in got] == [0.0, 1.0, 2.0, pytest.approx(80 / 30), pytest.approx(80 / 30)]
    assert audits.rate_by_label(audits.counter_rate(samples, ["k"])).count() == 5


def test_lag_counts_unread_partitions_whole(spark):
    latest = spark.createDataFrame([(0, 100), (1, 40)], "partition int, offset bigint")
    done = spark.createDataFrame([(0, 70)], "partition int, offset bigint")
    lags = audits.consumer_lag(latest, done)
    assert values(lags, "partition", "lag") == [(0, 30), (1, 40)]
    assert audits.max_lag(lags).first()[0] == 40


def test_skew_and_counts(spark):
    events = readings(spark, [speed(n, n) for n in range(3)] + [tick(9)])
    row = audits.skew_report(events, ["car_id"]).filter("car_id = 'CAR-01'").first()
    assert (row["readings"], row["share"], row["to_mean"]) == (3, 0.75, 1.5)
    assert [tuple(r) for r in audits.car_summary(events).collect()] == [("CAR-01", 3, at(2)), ("CAR-99", 1, at(9))]
    assert audits.count_by_sensor(events, "gear").isEmpty()
    assert audits.count_by_sensor(events, "speed").first()["readings"] == 4
    assert audits.events_per_second(events).count() == 4
    nan = readings(spark, [speed(1, float("nan")), speed(2, 1)])
    assert audits.nan_audit(nan).first()["nan_values"] == 1


def test_catalogue(spark):
    names = [row["sensor_id"] for row in catalogue.sensor_catalogue(spark, 5).collect()]
    assert names == ["speed", "engine-rpm", "throttle-position", "brake-pressure", "steering-angle"]
    assert catalogue.sensor_catalogue(spark, 100).filter("sensor_id like 'aux-channel-%'").count() == 60
    for count, total in ((20, 1740), (40, 5392), (100, 11630), (300, 33780)):
        assert catalogue.sensor_catalogue(spark, count).agg(F.sum("rate_hz")).first()[0] == total
    row = catalogue.sensor_catalogue(spark, 60).filter("sensor_id = 'aux-channel-010'").first()
    assert (row["rate_hz"], row["shape"], row["maximum_value"]) == (10, "LAP_CORRELATED", 100.0)


def test_target_rates(spark):
    two = catalogue.sensor_catalogue(spark, 2)
    assert catalogue.target_rate(two, 3, 2.0).first()[0] == 1800
    assert catalogue.target_rate(catalogue.sensor_catalogue(spark, 100), 20).first()[0] == 232_600
    scaled = catalogue.scale_rate(two, 2.0, 3.0).filter("sensor_id = 'speed'").first()
    assert (scaled["effective_rate_hz"], scaled["period_ns"]) == (600.0, 1_666_666)
    assert catalogue.scale_rate(two, 100.0, 50.0).agg(F.min("period_ns")).first()[0] == 1000


@pytest.mark.parametrize("cars, sensors, scale", [(0, 1, 1.0), (201, 1, 1.0), (1, 0, 1.0), (1, 2001, 1.0), (1, 1, 0.001), (1, 1, 101.0)])
def test_load_limits(cars, sensors, scale):
    with pytest.raises(ValueError):
        catalogue.validate_load(cars, sensors, scale)


def test_burst_limits():
    catalogue.validate_burst(1.0, 600)
    for multiplier, seconds in ((0.5, 1), (51, 1), (2, 0), (2, 601)):
        with pytest.raises(ValueError):
            catalogue.validate_burst(multiplier, seconds)


def test_seed_series(spark):
    from tachyline.sources.readings import seed_series

    rows = seed_series(spark, cars=2, ticks=100)
    assert rows.count() == 2 * 100 * 25
    row = rows.filter("car_id = 'CAR-02' and sensor_id = 'engine-rpm' and sequence_no = 99").first()
    assert row["event_time"] == dt.datetime(2024, 1, 1, 0, 0, 2, 970000)
    import math

    assert row["value"] == pytest.approx(4000 + 11000 * (0.5 + 0.45 * math.sin(99 / 3000 + 2)))
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert dedupe.integrity_check(rows).first()["duplicates"] == 0
