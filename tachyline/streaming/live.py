"""Streaming rollups and alerts.

Late rows. A window accepts readings until stream time passes its end plus the grace
period, then comes out once. Spark's stream time moves per micro-batch and over all
partitions, and with several stateful operators allowed it filters late rows by the
watermark of the batch before. A rollup query therefore starts with that setting off,
holds exactly one stateful operator, and drops by the current watermark; rows that are
late only within their own micro-batch are still counted. ``late_audit`` gives the
exact per-record answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tachyline.functions.time import iso_duration
from tachyline.operators.alerts import alerts_for
from tachyline.operators.board import session_stats
from tachyline.operators.rollups import rollup
from tachyline.schemas import KEY, SERIES
from tachyline.sources.topics import Topic, event_records
from tachyline.sources.wire import alerts_to_json, rollups_to_json

ONE_STATEFUL = "spark.sql.streaming.statefulOperator.allowMultiple"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Counting a store's rows costs a lookup for every row that is put; nothing here reads the count.
COUNT_ROWS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
STATEFUL_NODES = ("Aggregate ", "Deduplicate", "TransformWithState", "FlatMapGroupsWithState")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time a query starts; a query keeps its own copy."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _start(writer: DataStreamWriter, spark: SparkSession, single: bool, **trigger) -> StreamingQuery:
    settings = {ONE_STATEFUL: str(not single).lower(), STATE_STORE: ROCKSDB, COUNT_ROWS: "false"}
    with _settings(spark, settings):
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def run_single(writer: DataStreamWriter, spark: SparkSession, **trigger) -> StreamingQuery:
    """Start a query that holds one stateful operator, or none."""
    return _start(writer, spark, True, **trigger)


def _require_stateless(readings: DataFrame) -> None:
    plan = readings._jdf.queryExecution().analyzed().toString()
    found = [node.strip() for node in STATEFUL_NODES if node in plan]
    if found:
        raise ValueError(f"a rollup query must be its only stateful operator; input has {found}")


def windowed(readings: DataFrame, window: str, grace: str) -> DataFrame:
    """Final-only rollups of a stream of readings.

    ``grace`` is required: the longest dropout the source can have is its lower
    bound. Replayed readings count twice while their window is open; where that matters, put
    ``start_distinct`` before.
    """
    _require_stateless(readings)
    return rollup(readings.withWatermark("event_time", grace), window)


def start_distinct(
    readings: DataFrame, grace: str, topic: Topic, checkpoint: str, wire_format: str = "protobuf", **trigger
) -> StreamingQuery:
    """Publish each reading once, as it arrives: replays within ``grace`` are dropped.

    A query of its own, so that the rollups behind it stay their query's only stateful
    operator and keep the exact late rule. Readings later than ``grace`` are dropped here.
    """
    _require_stateless(readings)
    once = readings.withWatermark("event_time", grace).dropDuplicatesWithinWatermark(KEY)
    records = event_records(once, wire_format)
    return _start(topic.sink(records, checkpoint), readings.sparkSession, True, **trigger)


def start_rollups(
    readings: DataFrame, window: str, grace: str, topic: Topic, checkpoint: str, **trigger
) -> StreamingQuery:
    """Publish the rollups of one window length. Start one query per length, on one topic.

    Two lengths share nothing but the source: each has its own state, and late rules
    apply to the readings, so a longer window is never built from a shorter one here.
    """
    records = rollups_to_json(windowed(readings, window, grace))
    sink = topic.sink(records, checkpoint, iso_duration(window) if topic.writers else None)
    return _start(sink, readings.sparkSession, True, **trigger)


def start_alerts(
    rollups: DataFrame, rules: DataFrame, topic: Topic, checkpoint: str, **trigger
) -> StreamingQuery:
    """Publish alerts from the published rollups of every length: stateless, so no second window state."""
    records = alerts_to_json(alerts_for(rollups, rules))
    return _start(topic.sink(records, checkpoint), rollups.sparkSession, True, **trigger)


def start_session_stats(rollups: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep running per-series statistics: one table of all series, however long the stream runs."""
    from tachyline.streaming.views import View

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        return batch if before is None else batch.unionByName(before.join(batch.select(*SERIES), SERIES, "left_anti"))

    return View(path, checkpoint).start(session_stats(rollups), merge, "update", **trigger)


def current_session(spark: SparkSession, path: str) -> DataFrame:
    """The newest statistics of each series written by ``start_session_stats``."""
    from tachyline.streaming.views import current

    return current(spark, path)


def dropped_rows(query: StreamingQuery) -> int:
    """Late rows the query has dropped, over the progress reports it still holds."""
    return sum(
        state.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for state in progress.stateOperators
    )


def source_lag(query: StreamingQuery) -> int:
    """The largest number of records any source is behind; 0 when it does not say."""
    progress = query.lastProgress
    if progress is None:
        return 0
    behind = [int((source.metrics or {}).get("maxOffsetsBehindLatest", 0)) for source in progress.sources]
    return max(behind, default=0)
