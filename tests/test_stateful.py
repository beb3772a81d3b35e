import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import W, readings, speed, tick, values
from test_streaming import Feed, ONCE
from tachyline.operators.audits import late_audit
from tachyline.operators.rollups import rollup
from tachyline.plans.files import Files
from tachyline.schemas import alert_rules
from tachyline.sources import topics, wire
from tachyline.streaming import stateful, views

SECOND = dt.timedelta(seconds=1)


def late_rows():
    """Early and late readings of two cars in turn; one is late only behind a reading of its own batch."""
    rows = [speed(0.1, 200), tick(12), speed(0.9, 400), speed(5, 1), ("CAR-02", "gear", 1.5, 3), tick(60), speed(20, 5)]
    rows += [speed(9.5, 7), speed(8.99, 9), ("CAR-02", "gear", 1.9, 5), speed(10.2, float("nan")), speed(10.4, 2), speed(40, 8)]
    return rows + [speed(28.9, 1), speed(29.1, 2), speed(41, 0), tick(61)]


@pytest.mark.parametrize("together", [True, False])
def test_the_exact_late_rule_does_not_depend_on_micro_batches(spark, place, together):
    """The same rollups and the same late readings, all in one micro-batch or one reading in each."""
    rows = late_rows()
    feed = Feed(spark, place)
    feed.send(rows, together=together)
    stateful.start_exact_rollups(
        feed.readings(), "1 second", "10 seconds", f"{place}/log", f"{place}/c", "car_id", **ONCE
    ).awaitTermination()
    audited = late_audit(readings(spark, rows), "10 seconds", partition=["car_id"])
    ends = audited.groupBy("car_id").agg(F.max("stream_time").alias("now"))
    closed = rollup(audited.filter("not late"), "1 second").join(ends, "car_id").filter(
        F.col("window_end") + F.expr("INTERVAL '10' SECOND") <= F.col("now")
    )
    columns = ["car_id", "sensor_id", "window_start", "window_end", "window_length", "count", "average", "minimum", "maximum"]
    shown = lambda frame: [tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in row) for row in values(frame, *columns)]
    assert shown(stateful.exact_rollups(spark, f"{place}/log")) == shown(closed)
    late = audited.groupBy("car_id").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if("late").alias("late_readings"),
        (F.max("lateness_us") / 1e6).alias("worst_lateness_s"), F.max("stream_time").alias("stream_time"),
    )
    names = ["readings", "late_readings", "worst_lateness_s", "stream_time"]
    assert values(stateful.late_reports(spark, f"{place}/log"), "stream_partition", *names) == values(late, "car_id", *names)
    assert late.agg(F.sum("late_readings")).first()[0] == 4


def test_open_windows_and_counts_survive_a_restart(spark, place):
    feed = Feed(spark, place)
    for rows in ([speed(0.1, 200)], [speed(0.5, 100), speed(11, 1)], [speed(0.7, 9)]):
        topics.write_events(readings(spark, rows), feed.events)
        stateful.start_exact_rollups(
            feed.readings(), "1 second", "10 seconds", f"{place}/log", f"{place}/c", "car_id", **ONCE
        ).awaitTermination()
    assert values(stateful.exact_rollups(spark, f"{place}/log"), "window_start", "count", "average") == [(W, 2, 150.0)]
    assert values(stateful.late_reports(spark, f"{place}/log"), "readings", "late_readings") == [(4, 1)]
    Files(spark).make(feed.rollups.path)
    stateful.start_publish(spark, f"{place}/log", feed.rollups, f"{place}/p", **ONCE).awaitTermination()
    assert feed.published() == [(2, 150.0, 100.0, 200.0)]


class Kept:
    """The state of one key, without Spark."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_closed_windows_leave_python_in_pieces(monkeypatch):
    """However many windows a micro-batch closes, a piece of them stands in Python as strings at a time."""
    monkeypatch.setattr(stateful, "WINDOWS_AT_ONCE", 100)
    windows = stateful.ExactWindows(1_000_000, 2_000_000)
    windows.state, found = Kept(), []
    for part in range(2):
        numbers = range(part * 600, part * 600 + 600)
        rows = [(f"S{n % 3}", n * 500_000, float(n), n) for n in numbers]
        frames = [pd.DataFrame(rows[at : at + 250], columns=["sensor_id", "time", "value", "arrival"]).assign(car_id="C") for at in (250, 0, 500)]
        pieces = [piece for piece in windows.handleInputRows(("C",), iter(frames), None) if piece["kind"].iloc[0] == "rollup"]
        assert len(pieces) > 1 and max(map(len, pieces)) <= 100
        found += [row for piece in pieces for row in zip(piece["sensor_id"], piece["window_start"], piece["count"], piece["average"])]
    wanted = [(f"S{n % 3}", n // 2 * 1_000_000, 1, float(n)) for n in range(1200)]
    assert sorted(found) == sorted(row for row in wanted if row[1] + 3_000_000 <= 1199 * 500_000)


def raised(spark, rows):
    """Alerts of (car, second, threshold); a window of one second each."""
    data = [(car, "speed", W + SECOND * (at - 1), W + SECOND * at, 400.0, float(limit), W + SECOND * came) for car, at, limit, came in rows]
    return spark.createDataFrame(
        data, "car_id string, sensor_id string, window_start timestamp, window_end timestamp, "
        "observed_maximum double, threshold double, arrived_at timestamp",
    )


def publish(spark, feed, rows):
    records = wire.alerts_to_json(raised(spark, rows).withColumnRenamed("arrived_at", "timestamp"), keep=("timestamp",))
    feed.alerts.append(records.withColumn("partition", F.lit(0)).withColumn("offset", F.lit(None).cast("bigint")).coalesce(1))


def test_a_breach_is_over_when_its_time_has_passed(spark, place):
    feed = Feed(spark, place)
    parts = [
        [("CAR-01", 1, 300, 1), ("CAR-01", 1, 350, 1), ("CAR-01", 20, 300, 20), ("CAR-02", 20, 300, 20)],
        [("CAR-02", 61, 300, 61)],
        [("CAR-02", 200, 300, 200), ("CAR-03", 200, 300, 200)],
    ]
    for part in parts:
        publish(spark, feed, part)
        changes = stateful.breach_changes(topics.read_alerts(spark, feed.alerts), "5 seconds")
        stateful.start_changes(changes, f"{place}/changes", f"{place}/c", **ONCE).awaitTermination()
    got = [(car, (at - W).total_seconds(), on, limit) for car, at, on, limit in values(spark.read.parquet(f"{place}/changes"), "car_id", "at", "active", "threshold")]
    assert got == [
        ("CAR-01", 1, True, 350.0), ("CAR-01", 20, True, 300.0), ("CAR-01", 50, False, None), ("CAR-02", 20, True, 300.0),
        ("CAR-02", 50, False, None), ("CAR-02", 61, True, 300.0), ("CAR-02", 91, False, None), ("CAR-02", 200, True, 300.0),
        ("CAR-03", 200, True, 300.0),
    ]


def test_the_history_is_by_arrival_and_bounded(spark, place):
    """As many as the history holds, the last to arrive first, also after a lost checkpoint."""
    feed = Feed(spark, place)
    for n, part in enumerate(([("CAR-01", 50, 300, 1), ("CAR-02", 10, 300, 5)], [("CAR-03", 5, 300, 7), ("CAR-01", 6, 300, 6)])):
        publish(spark, feed, part)
        views.start_alert_history(topics.read_alerts(spark, feed.alerts), 3, f"{place}/h", f"{place}/c", **ONCE).awaitTermination()
    expected = [("CAR-03", 5), ("CAR-01", 6), ("CAR-02", 10)]

    def shown():
        rows = views.current(spark, f"{place}/h").orderBy(F.desc("arrived_at")).collect()
        return [(row["car_id"], (row["window_end"] - W).total_seconds()) for row in rows]

    assert shown() == expected
    publish(spark, feed, [("CAR-04", 1, 300, 2)])
    views.start_alert_history(topics.read_alerts(spark, feed.alerts), 3, f"{place}/h", f"{place}/c2", **ONCE).awaitTermination()
    assert shown() == expected and len(Files(spark).children(f"{place}/h")) <= 2
