"""Tables that several registered queries read, built once per session and input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tachyline.operators.rollups import of_length, rollup_lengths
from tachyline.plans import ingest, lifecycle
from tachyline.plans.files import Files, scratch_path
from tachyline.plans.store import READING_COLUMNS, Store
from tachyline.schemas import LIVE_ROLLUP, alert_rules
from tachyline.sources import topics, wire
from tachyline.sources.readings import channel_readings, event_readings
from tachyline.streaming import ingest as stream_ingest, live
from tachyline.workload.faults import Dropout, apply_dropout, plan_dropout

SLICES = 3
SLICE_ROWS = 1_000_000_000
DROPOUT = {
    "start": "2024-01-01 00:00:10",
    "end": "2024-01-01 00:00:20",
    "replay_at": "2024-01-01 00:00:25",
    "overlap": 100,
    "capacity": 250,
}
RULES = [
    ("brake-temperature-front-left", 1050.0),
    ("engine-rpm", 15500.0),
    ("speed", 300.0),
    ("speed", 380.0),
]
_built: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def dropout_plan(spark: SparkSession, sf_dir: str) -> Dropout | None:
    return _once(
        spark, sf_dir, "dropout", lambda: plan_dropout(channel_readings(spark, sf_dir), **DROPOUT)
    )


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense readings as a dropout and its replay deliver them."""
    return apply_dropout(channel_readings(spark, sf_dir), dropout_plan(spark, sf_dir))


def spread_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table's readings spread over some hours: one every few seconds, by event number."""
    hours = F.expr("INTERVAL '0.007' SECOND") * (F.col("sequence_no") * 1000)
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + hours
    return event_readings(spark, sf_dir).withColumn("event_time", moment)


def slices(events: DataFrame) -> list[DataFrame]:
    """The readings cut along arrival into parts; together they are all of them.

    At least three, and more when a part would exceed ``SLICE_ROWS`` arrival numbers.
    """
    low, high = events.agg(F.min("arrival"), F.max("arrival")).first()
    count = max(SLICES, -(-(high - low + 1) // SLICE_ROWS))
    edges = [low + (high - low + 1) * part // count for part in range(count + 1)]
    return [
        events.filter((F.col("arrival") >= start) & (F.col("arrival") < end))
        for start, end in zip(edges, edges[1:])
    ]


def new_store(spark: SparkSession, label: str, chunk_hours: int = 1) -> Store:
    return Store(spark, scratch_path(spark, label), zoned=False, chunk_hours=chunk_hours).create()


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rollups of the dense readings, both lengths, written once.

    Alerts and the live board read this, never the readings.
    """

    def build() -> str:
        path = scratch_path(spark, "published")
        rows = rollup_lengths(channel_readings(spark, sf_dir))
        rows.hint("rebalance", "window_length").write.partitionBy("window_length").parquet(path)
        return path

    schema = LIVE_ROLLUP.replace("timestamp", "timestamp_ntz")
    return spark.read.schema(schema).parquet(_once(spark, sf_dir, "published", build))


def ingested(spark: SparkSession, sf_dir: str) -> Store:
    """The replayed readings after idempotent ingest in batches, the last one retried."""

    def build() -> Store:
        store = new_store(spark, "ingested")
        parts = slices(replayed(spark, sf_dir).select(*READING_COLUMNS))
        for number, part in enumerate(parts):
            ingest.ingest_batch(part, number, store)
        ingest.ingest_batch(parts[-1], len(parts) - 1, store)
        return store

    return _once(spark, sf_dir, "ingested", build)


def one_batch(events: DataFrame, label: str, chunk_hours: int = 1) -> Store:
    store = new_store(events.sparkSession, label, chunk_hours)
    ingest.ingest_batch(events, 0, store)
    return store


def history(spark: SparkSession, sf_dir: str) -> Store:
    """A month of sparse readings with both aggregates filled."""

    def build() -> Store:
        store = one_batch(event_readings(spark, sf_dir), "history", chunk_hours=24)
        lifecycle.backfill(store)
        return store

    return _once(spark, sf_dir, "history", build)


class LiveRun:
    """Paths of one streaming run over the event topic, and how it is fed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)
        self.events = topics.Topic(topics.EVENTS, root=self.root)
        self.alerts = topics.Topic(topics.ALERTS, root=self.root)
        Files(spark).make(self.alerts.path)

        self.rollups = topics.Topic(topics.ROLLUPS, root=self.root, writers=("PT1S", "PT1M"))
        for path in self.rollups.paths:
            Files(spark).make(path)
        self.dropped: dict[int, int] = {}

    def readings(self, topic: topics.Topic | None = None) -> DataFrame:
        return wire.good_readings(topics.read_events(self.spark, topic or self.events))

    def feed(self, parts: list[DataFrame], steps: list[Callable[[], object]]) -> None:
        """Publish the readings part by part; after each, run every query to its end."""
        for part in parts:
            topics.write_events(part, self.events)
            for number, step in enumerate(steps):
                query = step()
                query.awaitTermination()
                self.dropped[number] = self.dropped.get(number, 0) + live.dropped_rows(query)


def around_replay(events: DataFrame) -> list[DataFrame]:
    """The replayed readings in two parts: what arrives before the replay begins, and the rest."""
    first = events.filter("replayed").agg(F.min("arrival")).first()[0]
    rows = events.drop("replayed")
    if first is None:
        return [rows]
    return [rows.filter(F.col("arrival") < first), rows.filter(F.col("arrival") >= first)]


def live_run(spark: SparkSession, sf_dir: str) -> LiveRun:
    """One-second and one-minute rollups, alerts, statistics and ingest from the topic."""

    def build() -> LiveRun:
        run = LiveRun(spark, "live")
        rules = alert_rules(spark, RULES)
        store = Store(spark, f"{run.root}/store").create()
        once = {"availableNow": True}
        run.feed(
            slices(channel_readings(spark, sf_dir)),
            [
                lambda: live.start_rollups(
                    run.readings(), "1 second", "10 seconds", run.rollups, f"{run.root}/c1", **once
                ),
                lambda: live.start_rollups(
                    run.readings(), "1 minute", "10 seconds", run.rollups, f"{run.root}/c2", **once
                ),
                lambda: live.start_alerts(
                    topics.read_rollups(spark, run.rollups), rules, run.alerts, f"{run.root}/c3", **once
                ),
                lambda: live.start_session_stats(
                    of_length(topics.read_rollups(spark, run.rollups)),
                    f"{run.root}/session", f"{run.root}/c4", **once,
                ),
                lambda: stream_ingest.start_ingest(
                    topics.read_events(spark, run.events), store, f"{run.root}/c5", **once
                ),
            ],
        )
        return run

    return _once(spark, sf_dir, "live", build)


def thirds(rows: DataFrame, column: str) -> list[DataFrame]:
    """The rows cut into three parts of equal length in time; what is not above an edge comes before it."""
    low, high = rows.agg(F.min(F.unix_micros(F.col(column).cast("timestamp"))), F.max(F.unix_micros(F.col(column).cast("timestamp")))).first()
    at = F.unix_micros(F.col(column).cast("timestamp"))
    edges = [low - 1, *(low + (high - low) * part // SLICES for part in range(1, SLICES + 1))]
    return [rows.filter((at > after) & (at <= until)) for after, until in zip(edges, edges[1:])]


def as_records(rows: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rollups or alerts as records of a directory topic; ``arrived_at`` is when they were appended."""
    names = [field.name for field in rows.schema if field.dataType.typeName() == "timestamp_ntz"]
    zoned = topics.dealt(rows, "window_start").withColumns({name: F.col(name).cast("timestamp") for name in names})
    records = encode(zoned.withColumnRenamed("arrived_at", "timestamp"), keep=("timestamp",))
    return records.withColumn("partition", F.lit(0)).withColumn("offset", F.lit(None).cast("bigint"))


def late_arrivals(alerts: DataFrame) -> DataFrame:
    """Alerts with the time they arrived: each car's come some seconds after the window, by its number."""
    behind = F.expr("INTERVAL '7' SECOND") * F.substring("car_id", 5, 2).cast("int")
    return alerts.withColumn("arrived_at", F.col("window_end") + behind)


def broken_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as topic records that went wrong on the way, by event number.

    Of each eight, one is cut short, one is null, one names a time no calendar has.
    """
    events = event_readings(spark, sf_dir)
    kept = ("arrival", "event_time", "sequence_no")
    kind = F.col("sequence_no") % 8
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    records = wire.encode(timed, keep=kept)
    body = F.col("value")
    # Field 3, the milliseconds, once more: the last one counts.
    endless = F.concat(body, F.unhex(F.lit("18FFFFFFFFFFFFFFFF7F")))
    broken = (
        F.when(kind == 1, F.substring(body, 1, F.octet_length(body) - 1))
        .when(kind == 3, F.lit(None).cast("binary"))
        .when(kind == 5, endless)
        .otherwise(body)
    )
    return records.select(
        "key", broken.alias("value"), topics.partition_of().alias("partition"),
        F.col("arrival").alias("offset"), F.col("event_time").alias("timestamp"),
    )


def accounted(spark: SparkSession, sf_dir: str) -> Store:
    """A store fed by a stream of ``broken_records``."""

    def build() -> Store:
        run = LiveRun(spark, "broken")
        store = Store(spark, f"{run.root}/store", chunk_hours=24).create()
        run.events.append(broken_records(spark, sf_dir))
        stream_ingest.start_ingest(
            topics.read_events(spark, run.events), store, f"{run.root}/c1", availableNow=True
        ).awaitTermination()
        return store

    return _once(spark, sf_dir, "broken", build)
