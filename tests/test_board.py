import datetime as dt

from pyspark.sql import functions as F

from helpers import W, readings, speed, values
from tachyline.operators import alerts, board, rollups
from tachyline.schemas import alert_rules
from tachyline.sources.catalogue import sensor_catalogue

ROWS = [
    speed(0.1, 200), speed(0.2, 220), speed(1.5, 300),
    ("CAR-01", "gear", 1.5, 6.5), ("CAR-01", "engine-rpm", 1.0, 16000), ("CAR-02", "speed", 0.5, 100),
    ("CAR-03", "gear", 0.5, 3),
]


def seconds(spark):
    return rollups.rollup(readings(spark, ROWS), "1 second")


def test_session_stats_weight_by_count(spark):
    row = board.session_stats(seconds(spark)).filter("car_id = 'CAR-01' and sensor_id = 'speed'").first()
    assert (row["peak"], row["mean"], row["samples"]) == (300.0, 240.0, 3)


def test_latest_reading_is_the_last_window(spark):
    row = board.latest_reading(seconds(spark)).filter("car_id = 'CAR-01' and sensor_id = 'speed'").first()
    assert (row["average"], row["count"], row["window_start"]) == (300.0, 1, W + dt.timedelta(seconds=1))


def test_signal_needs_recent_speed(spark):
    states = board.live_signal(seconds(spark), W + dt.timedelta(seconds=8))
    assert values(states, "car_id", "has_signal") == [("CAR-01", True), ("CAR-02", False), ("CAR-03", False)]


def test_board_has_one_card_per_car(spark):
    rows = seconds(spark)
    raised = alerts.alerts_for(rows, alert_rules(spark))
    card = board.live_board(rows, raised, W + dt.timedelta(seconds=3)).filter("car_id = 'CAR-01'").first()
    assert (card["speed"], card["gear"], card["engine_rpm"]) == (300.0, 7, 16000.0)
    assert (card["average_speed"], card["top_speed"], card["has_signal"]) == (240.0, 300.0, True)
    assert (card["breach_sensor"], card["breach_threshold"]) == ("engine-rpm", 15500.0)
    assert card["throttle"] is None
    late = board.live_board(rows, raised, W + dt.timedelta(seconds=60)).filter("car_id = 'CAR-01'").first()
    assert late["breach_sensor"] is None and late["has_signal"] is False


def test_other_cars_are_sorted_with_current_speed(spark):
    rows = [tuple(row) for row in board.other_cars(seconds(spark), ["CAR-01"]).collect()]
    assert rows == [("CAR-02", 100.0), ("CAR-03", None)]


def test_context_clamps_and_keeps_unknown_channels(spark):
    rows = rollups.rollup(readings(spark, [("CAR-01", "speed", 0.1, 720), ("CAR-01", "speed", 1.1, 90), ("CAR-01", "mystery", 0.1, 1)]), "1 second")
    got = values(board.channel_context(rows, sensor_catalogue(spark)), "sensor_id", "fraction", "unit")
    assert got == [("mystery", None, None), ("speed", 0.25, "km/h"), ("speed", 1.0, "km/h")]


def test_an_empty_channel_range_has_no_fraction(spark):
    rows = rollups.rollup(readings(spark, [("CAR-01", "speed", 0.1, 5)]), "1 second")
    flat = sensor_catalogue(spark, 1).withColumn("maximum_value", F.col("minimum_value"))
    assert values(board.channel_context(rows, flat), "sensor_id", "fraction") == [("speed", None)]


def test_latest_reading_takes_one_second_rows_only(spark):
    both = rollups.rollup_lengths(readings(spark, [speed(59.5, 1), speed(59.9, 3)]))
    assert values(board.latest_reading(both), "count", "window_start") == [(2, W + dt.timedelta(seconds=59))]


def test_lanes_scale_to_their_own_span(spark):
    rows = rollups.rollup(readings(spark, [speed(0, 10), speed(1, 20), speed(2, 15), ("CAR-01", "gear", 0, 4)]), "1 second")
    assert values(board.lane_scale(rows), "sensor_id", "window_start", "lane")[0][2] == 0.0
    assert [lane for *_, lane in values(board.lane_scale(rows), "sensor_id", "window_start", "lane")[1:]] == [0.0, 1.0, 0.5]
