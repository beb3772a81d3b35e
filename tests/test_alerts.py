import datetime as dt

from helpers import W, readings, speed, values
from tachyline.operators import alerts, rollups
from tachyline.schemas import alert_rules


def raised(spark, rows, rules, window="1 second"):
    return alerts.alerts_for(rollups.rollup(readings(spark, rows), window), alert_rules(spark, rules))


def test_a_breach_raises_one_alert(spark):
    rows = raised(spark, [speed(0.1, 200), speed(0.4, 380)], [("speed", 350.0)])
    assert rows.columns == alerts.ALERT_COLUMNS
    assert values(rows, "car_id", "observed_maximum", "threshold") == [("CAR-01", 380.0, 350.0)]


def test_below_equal_and_other_sensors_raise_nothing(spark):
    assert raised(spark, [speed(0.1, 200), speed(0.2, 340)], [("speed", 350.0)]).isEmpty()
    assert raised(spark, [speed(0.1, 350.0)], [("speed", 350.0)]).isEmpty()
    assert raised(spark, [speed(0.1, 900)], [("brake-temperature-front-left", 100.0)]).isEmpty()


def test_nan_raises_nothing(spark):
    assert raised(spark, [speed(0.1, float("nan")), speed(0.2, 900)], [("speed", 350.0)]).isEmpty()


def test_two_rules_on_one_sensor_raise_two(spark):
    rows = raised(spark, [speed(0.1, 380)], [("speed", 300.0), ("speed", 350.0)])
    assert values(rows, "threshold") == [300.0, 350.0]


def test_each_window_length_raises_its_own(spark):
    live = rollups.rollup_lengths(readings(spark, [speed(0.1, 380)]))
    rows = alerts.alerts_for(live, alert_rules(spark, [("speed", 350.0)]))
    assert rows.count() == 2


def test_rules_beyond_the_broadcast_bound_still_join(spark, monkeypatch):
    from tachyline.plans import sizing

    monkeypatch.setattr(sizing.broadcast_if_small, "__defaults__", (1,))
    rows = raised(spark, [speed(0.1, 380)], [("speed", 300.0), ("speed", 350.0), ("gear", 1.0)])
    assert "ResolvedHint" not in rows._jdf.queryExecution().analyzed().toString()
    assert rows.count() == 2


def test_shipped_rules(spark):
    assert values(alert_rules(spark), "sensor_id", "maximum") == [
        ("brake-temperature-front-left", 1050.0), ("engine-rpm", 15500.0),
    ]


def history(spark, count):
    rows = [
        ("CAR-01", "speed", W + dt.timedelta(seconds=n), W + dt.timedelta(seconds=n + 1), 300.0 + n, 300.0, n)
        for n in range(1, count + 1)
    ]
    return spark.createDataFrame(
        rows,
        "car_id string, sensor_id string, window_start timestamp, window_end timestamp, "
        "observed_maximum double, threshold double, arrival int",
    )


def test_history_is_newest_first_and_bounded(spark):
    recent = alerts.recent_alerts(history(spark, 3), 200, arrival="arrival").collect()
    assert [row["arrival"] for row in recent] == [3, 2, 1]
    recent = alerts.recent_alerts(history(spark, 5), 3, arrival="arrival").collect()
    assert [row["arrival"] for row in recent] == [5, 4, 3]


def test_latest_breach_and_its_hold(spark):
    rows = history(spark, 4)
    last = alerts.latest_breach(rows).first()
    assert (last["observed_maximum"], last["excess"], last["at"]) == (304.0, 4.0, W + dt.timedelta(seconds=5))
    assert not alerts.active_breach(rows, W + dt.timedelta(seconds=35)).isEmpty()
    assert alerts.active_breach(rows, W + dt.timedelta(seconds=35.001)).isEmpty()
    assert values(alerts.alerts_fired(rows), "sensor_id", "alerts") == [("speed", 4)]
