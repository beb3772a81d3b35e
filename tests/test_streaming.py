import pytest
from pyspark.sql import functions as F

from helpers import W, readings, speed, tick, values
from tachyline.operators import dedupe, rollups
from tachyline.plans.files import Files
from tachyline.plans.store import Store
from tachyline.schemas import alert_rules
from tachyline.sources import topics, wire
from tachyline.streaming import ingest, live
from tachyline.workload.stores import as_records

ONCE = {"availableNow": True}


class Feed:
    """A directory topic fed one record at a time, so that each is a micro-batch."""

    def __init__(self, spark, root, wire_format="protobuf"):
        self.spark, self.root, self.wire_format = spark, root, wire_format
        self.events = topics.Topic(topics.EVENTS, root=root)
        self.rollups = topics.Topic(topics.ROLLUPS, root=root)
        self.alerts = topics.Topic(topics.ALERTS, root=root)
        self.once = topics.Topic(topics.EVENTS, root=f"{root}/once")
        for topic in (self.events, self.rollups, self.alerts, self.once):
            Files(spark).make(topic.path)

    def send(self, rows, together=False):
        events = readings(self.spark, rows)
        parts = [events] if together else [events.filter(F.col("arrival") == n) for n in range(len(rows))]
        for part in parts:
            topics.write_events(part.coalesce(1), self.events, self.wire_format)

    def readings(self):
        return wire.good_readings(
            topics.read_events(self.spark, self.events, self.wire_format, per_trigger=1)
        )

    def roll(self, grace="10 seconds", window="1 second", distinct=False):
        readings = self.readings()
        if distinct:
            live.start_distinct(
                readings, grace, self.once, f"{self.root}/check-once", self.wire_format, **ONCE
            ).awaitTermination()
            readings = wire.good_readings(
                topics.read_events(self.spark, self.once, self.wire_format, per_trigger=1)
            )
        query = live.start_rollups(
            readings, window, grace, self.rollups, f"{self.root}/check-{window}", **ONCE
        )
        query.awaitTermination()
        return query

    def published(self, car="CAR-01"):
        rows = wire.json_to_rollups(self.rollups.table(self.spark)).filter(F.col("car_id") == car)
        return values(rows, "count", "average", "minimum", "maximum")


CASES = {
    "closes": ([speed(0.1, 200), speed(0.5, 220), tick(12)], "10 seconds", [(2, 210.0, 200.0, 220.0)]),
    "stats": ([speed(0.1, 200), speed(0.3, 300), speed(0.7, 100), tick(12)], "10 seconds", [(3, 200.0, 100.0, 300.0)]),
    "late within": ([speed(0.1, 200), tick(5), speed(0.9, 400), tick(12)], "10 seconds", [(2, 300.0, 200.0, 400.0)]),
    "late after": ([speed(0.1, 200), tick(12), speed(0.9, 400), tick(60)], "10 seconds", [(1, 200.0, 200.0, 200.0)]),
    "wide grace": ([speed(0.1, 200), tick(11), speed(0.9, 400), tick(62)], "60 seconds", [(2, 300.0, 200.0, 400.0)]),
    "at the boundary": ([speed(0.1, 200), tick(11)], "10 seconds", [(1, 200.0, 200.0, 200.0)]),
    "before the boundary": ([speed(0.1, 200), tick(10.999)], "10 seconds", []),
}


@pytest.mark.parametrize("name", CASES)
def test_windows_close_after_grace(spark, place, name):
    rows, grace, expected = CASES[name]
    feed = Feed(spark, place)
    feed.send(rows)
    query = feed.roll(grace)
    assert feed.published() == expected
    if name == "late after":
        assert live.dropped_rows(query) == 1
    assert spark.conf.get(live.ONE_STATEFUL, "true") == "true"


def test_json_gives_the_same_rollups(spark, place):
    feed = Feed(spark, place, "json")
    feed.send(CASES["stats"][0])
    feed.roll()
    assert feed.published() == CASES["stats"][2]


def test_rows_late_only_within_their_micro_batch_are_kept(spark, place):
    """The one-batch slack of stream time that moves per micro-batch."""
    feed = Feed(spark, place)
    feed.send([speed(0.1, 200), tick(12), speed(0.9, 400), tick(60)], together=True)
    feed.roll()
    assert feed.published() == [(2, 300.0, 200.0, 400.0)]


def test_alerts_and_session_follow_the_rollups(spark, place):
    feed = Feed(spark, place)
    feed.send([speed(0.1, 200), speed(0.4, 380), ("CAR-01", "gear", 1.0, 3), tick(12)], together=True)
    feed.roll()
    rules = alert_rules(spark, [("speed", 350.0), ("gear", 5.0)])
    for _ in range(2):
        live.start_alerts(
            topics.read_rollups(spark, feed.rollups), rules, feed.alerts, f"{place}/check-alerts", **ONCE
        ).awaitTermination()
    raised = wire.json_to_alerts(feed.alerts.table(spark))
    assert values(raised, "car_id", "sensor_id", "window_start", "observed_maximum", "threshold") == [
        ("CAR-01", "speed", W, 380.0, 350.0)
    ]
    stream = topics.read_alerts(spark, feed.alerts)
    assert stream.isStreaming and "arrived_at" in stream.columns
    live.start_session_stats(
        topics.read_rollups(spark, feed.rollups), f"{place}/session", f"{place}/check-session", **ONCE
    ).awaitTermination()
    session = live.current_session(spark, f"{place}/session")
    assert values(session, "sensor_id", "peak", "mean", "samples") == [
        ("gear", 3.0, 3.0, 1), ("speed", 380.0, 290.0, 2)
    ]


@pytest.mark.parametrize("distinct, count", [(False, 2), (True, 1)])
def test_replays_inside_grace_count_twice_unless_deduplicated(spark, place, distinct, count):
    feed = Feed(spark, place)
    feed.send([speed(0.1, 200), speed(0.1, 200), tick(12), tick(40)])
    feed.roll(distinct=distinct)
    assert [row[0] for row in feed.published()] == [count]


def test_deduplication_keeps_the_late_rule(spark, place):
    feed = Feed(spark, place)
    rows, grace, expected = CASES["late after"]
    feed.send(rows)
    feed.roll(grace, distinct=True)
    assert feed.published() == expected


def test_session_statistics_keep_one_table(spark, place):
    feed = Feed(spark, place)
    for second in range(4):
        feed.send([speed(20 * second + 0.1, 100 + second), tick(20 * second + 15)])
        feed.roll()
        live.start_session_stats(
            topics.read_rollups(spark, feed.rollups), f"{place}/session", f"{place}/check-session", **ONCE
        ).awaitTermination()
    assert len(Files(spark).children(f"{place}/session")) <= 2
    session = live.current_session(spark, f"{place}/session").filter("car_id = 'CAR-01'")
    assert values(session, "peak", "samples") == [(103.0, 4)]


def test_two_lengths_share_a_topic(spark, place):
    feed = Feed(spark, place)
    feed.rollups = topics.Topic(topics.ROLLUPS, root=place, writers=("PT1S", "PT1M"))
    for path in feed.rollups.paths:
        Files(spark).make(path)
    feed.send([speed(0.1, 200), speed(1.5, 400), tick(200)], together=True)
    feed.roll()
    feed.roll(window="1 minute")
    assert [row[0] for row in feed.published()] == [1, 1, 2]
    with pytest.raises(ValueError):
        feed.roll(window="1 hour")
    live.start_alerts(
        topics.read_rollups(spark, feed.rollups), alert_rules(spark, [("speed", 350.0)]), feed.alerts,
        f"{place}/check-alerts", **ONCE,
    ).awaitTermination()
    assert wire.json_to_alerts(feed.alerts.table(spark)).count() == 2


def test_a_rollup_query_refuses_stateful_input(spark, place):
    feed = Feed(spark, place)
    once = feed.readings().withWatermark("event_time", "1 second").dropDuplicatesWithinWatermark(["car_id"])
    with pytest.raises(ValueError):
        live.windowed(once, "1 second", "10 seconds")
    assert live.windowed(feed.readings(), "1 minute", "10 seconds").isStreaming


def test_streaming_ingest_is_idempotent(spark, place):
    feed = Feed(spark, place)
    store = Store(spark, f"{place}/store").create()
    feed.send([speed(1, 1), speed(2, 2), speed(1, 9)], together=True)
    feed.send([speed(2, 7), speed(3, 3)], together=True)
    bad = spark.createDataFrame([("k", b"\x07", 0, 99, W)], "key string, value binary, partition int, offset bigint, timestamp timestamp")
    feed.events.append(bad)

    def run(checkpoint, per_trigger=1):
        ingest.start_ingest(
            topics.read_events(spark, feed.events, per_trigger=per_trigger),
            store, checkpoint, f"{place}/dead", **ONCE,
        ).awaitTermination()

    run(f"{place}/check-ingest")
    assert values(store.read("raw"), "value") == [1.0, 2.0, 3.0]
    counted = store.metrics().selectExpr("sum(received)", "sum(dead_letters)", "sum(consumed)").first()
    assert tuple(counted) == (6, 1, 5)
    dead = spark.read.parquet(f"{place}/dead")
    assert values(dead, "offset", "error") == [(99, "unsupported wire type")]
    # A lost checkpoint replays the whole topic, cut into other batches: nothing changes.
    run(f"{place}/check-again", per_trigger=10)
    assert values(store.read("raw"), "value") == [1.0, 2.0, 3.0]
    assert dedupe.integrity_check(store.read("raw")).first()["duplicates"] == 0
    # A resumed checkpoint keeps its ids, a fresh one gets new ones.
    assert ingest.first_batch_id(store, f"{place}/check-ingest") == 0
    later = ingest.first_batch_id(store, f"{place}/check-again")
    assert later > 0 and ingest.first_batch_id(store, f"{place}/check-third") > later
    feed.send([speed(9, 4)])
    run(f"{place}/check-ingest")
    assert values(store.read("raw"), "value") == [1.0, 2.0, 3.0, 4.0]


def test_progress_helpers(spark, place):
    feed = Feed(spark, place)
    feed.send([speed(0.1, 1)])
    query = feed.roll()
    assert live.source_lag(query) == 0


def test_statistics_follow_a_lost_checkpoint(spark, place):
    """A new checkpoint replays everything: its batches count from 0 again, and nothing stays as it was."""
    feed = Feed(spark, place)
    path = f"{place}/session"

    def stats(checkpoint):
        live.start_session_stats(topics.read_rollups(spark, feed.rollups), path, checkpoint, **ONCE).awaitTermination()
        return values(live.current_session(spark, path), "peak", "samples")

    for n in range(3):
        feed.send([speed(20 * n, n + 1), tick(20 * n + 15)], together=True)
        feed.roll()
        assert [row for row in stats(f"{place}/s1") if row[1] == n + 1 and row[0] == n + 1]
    feed.send([speed(60, 50), tick(75)], together=True)
    feed.roll()
    assert (50.0, 4) in stats(f"{place}/s2")
    feed.send([speed(80, 7), tick(95)], together=True)
    feed.roll()
    assert (50.0, 5) in stats(f"{place}/s2")
    assert len(Files(spark).children(path)) <= 2


def test_records_of_few_tasks_are_dealt_over_more(spark, place):
    """Readings and rollups that one task reads: several write the topic, so several can read it; none is lost."""
    rows = spark.range(0, 150_000, 1, 1).select(
        F.lit("CAR-01").alias("car_id"), F.concat(F.lit("sensor-"), F.col("id") % 40).alias("sensor_id"),
        F.timestamp_millis(F.col("id") * 30).alias("event_time"), F.rand(3).alias("value"),
        F.col("id").alias("sequence_no"), F.col("id").alias("arrival"),
    )
    events = topics.Topic(topics.EVENTS, root=place)
    topics.write_events(rows, events)
    got = events.table(spark)
    assert got.select(F.input_file_name()).distinct().count() > 1
    decoded = wire.good_readings(wire.decode(got)).select("sequence_no", "event_time", "value")
    assert decoded.exceptAll(rows.select("sequence_no", "event_time", "value")).count() == 0 and got.count() == 150_000
    seconds = rollups.rollup(rows, "1 second").coalesce(1)
    found = topics.Topic(topics.ROLLUPS, root=place)
    found.append(as_records(seconds.withColumn("arrived_at", F.col("window_end")), wire.rollups_to_json))
    assert found.table(spark).select(F.input_file_name()).distinct().count() > 1
    assert wire.json_to_rollups(found.table(spark)).count() == seconds.count()
