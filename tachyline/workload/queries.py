"""The registered queries: (session, table directory) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tachyline.functions.time import time_bucket
from tachyline.operators import alerts, audits, board, dedupe, ranges, rollups
from tachyline.plans import ingest, lifecycle, manifest
from tachyline.plans.blocked import by_position, by_time, position, running_sum
from tachyline.plans.files import Files, scratch_path
from tachyline.plans.store import READING_COLUMNS, Store
from tachyline.schemas import SERIES, alert_rules
from tachyline.sources import catalogue, topics, wire
from tachyline.sources.readings import channel_readings, dense_values, event_readings, event_ticks
from tachyline.streaming import live, stateful, views
from tachyline.workload import faults
from tachyline.workload.stores import (
    DROPOUT, RULES, LiveRun, accounted, around_replay, as_records, dropout_plan, history, ingested, late_arrivals,
    live_run, new_store, one_batch, published, replayed, slices, spread_readings, thirds,
)
from tachyline.workload.stores import _once as built_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GRACE = "2 seconds"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(rows: DataFrame, *names: str) -> DataFrame:
    """Means are not bit-stable between plans: compare them to six places."""
    return rows.withColumns({name: F.round(name, 6) for name in names})


def zoneless(rows: DataFrame) -> DataFrame:
    """Instants as zone-less UTC times, like the driver's tables."""
    zoned = [field.name for field in rows.schema if field.dataType.typeName() == "timestamp"]
    return rows.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned})


def second_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.of_length(published(spark, sf_dir))


def raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alerts_for(published(spark, sf_dir), alert_rules(spark, RULES))


def newest(rows: DataFrame, column: str = "event_time"):
    return rows.agg(F.max(column)).first()[0]


def last_second(spark: SparkSession, sf_dir: str):
    """End of the newest one-second window."""
    return newest(second_rows(spark, sf_dir), "window_end")


# --- rollups -----------------------------------------------------------------


@query
def rollup_1m(spark, sf_dir):
    return rounded(rollups.rollup_1m(event_readings(spark, sf_dir)), "average")


@query
def rollup_1h(spark, sf_dir):
    return rounded(rollups.rollup_1h(rollups.rollup_1m(event_readings(spark, sf_dir))), "average")


@query
def live_rollups(spark, sf_dir):
    rows = rollups.rollup_lengths(channel_readings(spark, sf_dir))
    return rounded(rows, "average", "minimum", "maximum")


@query
def rollups_emitted(spark, sf_dir):
    return rollups.rollups_emitted(published(spark, sf_dir))


@query
def dense_series_1m(spark, sf_dir):
    return rounded(
        rollups.rollup_1m(dense_values(event_ticks(spark, sf_dir))), "average", "minimum", "maximum"
    )


# --- alerts --------------------------------------------------------------------


@query
def threshold_alerts(spark, sf_dir):
    return rounded(raised(spark, sf_dir), "observed_maximum")


@query
def alerts_fired(spark, sf_dir):
    return alerts.alerts_fired(raised(spark, sf_dir))


@query
def recent_alerts(spark, sf_dir):
    return rounded(alerts.recent_alerts(raised(spark, sf_dir), 200), "observed_maximum")


@query
def breach_list(spark, sf_dir):
    return rounded(alerts.recent_alerts(raised(spark, sf_dir), 100), "observed_maximum")


@query
def latest_breach(spark, sf_dir):
    return rounded(alerts.latest_breach(raised(spark, sf_dir)), "observed_maximum", "excess")


@query
def active_breach(spark, sf_dir):
    now = last_second(spark, sf_dir)
    return rounded(alerts.active_breach(raised(spark, sf_dir), now), "observed_maximum", "excess")


@query
def anomaly_alerts(spark, sf_dir):
    flagged = faults.inject_anomaly(
        channel_readings(spark, sf_dir), catalogue.sensor_catalogue(spark), "CAR-02", "engine-rpm"
    )
    breaches = alerts.alerts_for(rollups.rollup(flagged, "1 minute"), alert_rules(spark))
    return rounded(breaches, "observed_maximum")


# --- live board ----------------------------------------------------------------


@query
def session_stats(spark, sf_dir):
    return rounded(board.session_stats(second_rows(spark, sf_dir)), "peak", "mean")


@query
def latest_reading(spark, sf_dir):
    rows = board.latest_reading(second_rows(spark, sf_dir))
    return rounded(rows, "average", "minimum", "maximum")


@query
def live_signal(spark, sf_dir):
    return board.live_signal(second_rows(spark, sf_dir), last_second(spark, sf_dir))


@query
def live_board(spark, sf_dir):
    rows = published(spark, sf_dir)
    now = last_second(spark, sf_dir)
    cards = board.live_board(rows, alerts.alerts_for(rows, alert_rules(spark, RULES)), now)
    return rounded(
        cards, "speed", "engine_rpm", "throttle", "brake", "average_speed", "top_speed",
        "brake_fl_peak", "breach_observed",
    )


@query
def other_cars(spark, sf_dir):
    return rounded(board.other_cars(published(spark, sf_dir), ["CAR-01", "CAR-02"]), "speed")


@query
def channel_context(spark, sf_dir):
    minutes = rollups.rollup_1m(channel_readings(spark, sf_dir))
    rows = board.channel_context(minutes, catalogue.sensor_catalogue(spark))
    return rounded(rows, "average", "minimum", "maximum", "fraction")


@query
def lane_scale(spark, sf_dir):
    minutes = history(spark, sf_dir).rollups().select(*ranges.ROLLUP_COLUMNS)
    return rounded(board.lane_scale(minutes), "average", "low", "high", "lane")


# --- range queries over the stored aggregates -------------------------------------


@query
def find_rollups_1m(spark, sf_dir):
    start, end = ranges.default_range("2024-01-12 00:00:00", start="2024-01-08 00:00:00")
    minutes = history(spark, sf_dir).rollups_between("ONE_MINUTE", start, end)
    return rounded(ranges.find_rollups(minutes, "CAR-01", "click", start, end), "average")


@query
def find_rollups_1h(spark, sf_dir):
    start, end = "2024-01-05 12:00:00", "2024-01-20 07:00:00"
    hours = history(spark, sf_dir).rollups_between("ONE_HOUR", start, end)
    found = ranges.find_rollups(hours, "CAR-03", "view", start, end, 100)
    return rounded(found, "average")


@query
def series_slice(spark, sf_dir):
    """Minutes of one series in a range of the compacted table, from the files its manifest names."""
    compacted = built_once(spark, sf_dir, "sliced", lambda: _compacted(spark, sf_dir))
    rows = manifest.read_series(compacted, "CAR-01", "click", "2024-01-08 06:30:00", "2024-01-12 00:00:00")
    return rounded(rollups.rollup_1m(rows), "average")


def _compacted(spark: SparkSession, sf_dir: str) -> Store:
    store = one_batch(event_readings(spark, sf_dir), "sliced", chunk_hours=24)
    lifecycle.compact(store, "9999-01-01 00:00:00")
    return store


@query
def find_channels(spark, sf_dir):
    start, end = "2024-01-03 00:00:00", "2024-01-25 00:00:00"
    minutes = history(spark, sf_dir).rollups_between("ONE_MINUTE", start, end)
    found = ranges.find_channels(minutes, "CAR-02", ["click", "view", "purchase"], start, end, 50)
    return rounded(found, "average")


@query
def cars(spark, sf_dir):
    return ranges.cars(history(spark, sf_dir).rollups())


@query
def sensors(spark, sf_dir):
    return ranges.sensors(history(spark, sf_dir).rollups())


@query
def channel_order(spark, sf_dir):
    seen = ranges.sensors(history(spark, sf_dir).rollups())
    padding = catalogue.sensor_catalogue(spark, 60).select("sensor_id")
    return ranges.channel_order(seen.unionByName(padding).distinct())


@query
def search_channels(spark, sf_dir):
    return ranges.search_channels(ranges.sensors(history(spark, sf_dir).rollups()), " IE ")


# --- identity -------------------------------------------------------------------


@query
def integrity_check(spark, sf_dir):
    return dedupe.integrity_check(replayed(spark, sf_dir))


@query
def duplicated_readings(spark, sf_dir):
    return dedupe.duplicated_readings(replayed(spark, sf_dir))


@query
def first_arrival(spark, sf_dir):
    return rounded(dedupe.first_arrival(replayed(spark, sf_dir)), "value")


@query
def dedupe_existing(spark, sf_dir):
    table = replayed(spark, sf_dir).withColumnRenamed("arrival", "id").drop("replayed")
    return rounded(dedupe.dedupe_existing(table), "value")


@query
def reject_stored(spark, sf_dir):
    rows = replayed(spark, sf_dir)
    incoming, stored = rows.filter("replayed"), rows.filter("not replayed")
    return rounded(dedupe.reject_stored(incoming, stored).drop("replayed"), "value")


@query
def replay_audit(spark, sf_dir):
    return dedupe.replay_audit(replayed(spark, sf_dir))


# --- replay and faults ------------------------------------------------------------


@query
def dropout_replay(spark, sf_dir):
    return rounded(replayed(spark, sf_dir), "value")


@query
def dropped_by_buffer(spark, sf_dir):
    lost = faults.dropped_by_buffer(
        channel_readings(spark, sf_dir), DROPOUT["start"], DROPOUT["end"], DROPOUT["capacity"]
    )
    return rounded(lost, "value")


@query
def last_delivered(spark, sf_dir):
    events = channel_readings(spark, sf_dir)
    middle = events.agg(F.floor(F.max("arrival") / 2)).first()[0]
    return rounded(faults.last_delivered(events, middle, 500), "value")


@query
def inject_anomaly(spark, sf_dir):
    flagged = faults.inject_anomaly(
        channel_readings(spark, sf_dir), catalogue.sensor_catalogue(spark), "CAR-04", "speed"
    )
    return rounded(flagged, "value")


# --- audits -----------------------------------------------------------------------


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.late_audit(replayed(spark, sf_dir), GRACE, partition=["car_id"])


@query
def late_audit(spark, sf_dir):
    return _late(spark, sf_dir).select(
        *SERIES, "event_time", "arrival", "window_end", "stream_time", "late", "lateness_us"
    )


@query
def late_summary(spark, sf_dir):
    return audits.late_summary(_late(spark, sf_dir), ["car_id"])


@query
def sequence_gaps(spark, sf_dir):
    after = F.col("event_time") >= F.lit("2024-01-01 00:00:22").cast("timestamp_ntz")
    runs = channel_readings(spark, sf_dir).withColumn("run", after)
    numbered = position(runs, [*SERIES, "run"], "arrival", "number", by_position("arrival"))
    sent = numbered.withColumn("sequence_no", F.col("number").cast("bigint")).drop("number", "run")
    received = dedupe.first_arrival(faults.apply_dropout(sent, dropout_plan(spark, sf_dir)))
    return audits.sequence_gaps(received)


@query
def systematic_sample(spark, sf_dir):
    return rounded(audits.systematic_sample(channel_readings(spark, sf_dir), 3), "value")


@query
def count_by_sensor(spark, sf_dir):
    return audits.count_by_sensor(event_readings(spark, sf_dir))


@query
def car_summary(spark, sf_dir):
    return audits.car_summary(event_readings(spark, sf_dir))


@query
def events_per_second(spark, sf_dir):
    return audits.events_per_second(channel_readings(spark, sf_dir))


@query
def nan_audit(spark, sf_dir):
    return audits.nan_audit(event_readings(spark, sf_dir))


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_second = (
        channel_readings(spark, sf_dir)
        .groupBy("car_id", time_bucket("1 second", "event_time").alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return running_sum(per_second, ["car_id"], "at", "n", "counter", by_time("at", "1 hour")).drop("n")


@query
def counter_rate(spark, sf_dir):
    return rounded(audits.counter_rate(_counters(spark, sf_dir), ["car_id"]), "rate")


@query
def rate_by_label(spark, sf_dir):
    rates = audits.counter_rate(_counters(spark, sf_dir), ["car_id"])
    return rounded(audits.rate_by_label(rates), "rate")


@query
def consumer_lag(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    offsets = events.select(
        (F.col("user_id") % 12).alias("partition"), F.col("event_id").alias("offset"), "ts"
    )
    read = offsets.filter(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    last = [F.max("offset").alias("offset")]
    return audits.consumer_lag(
        offsets.groupBy("partition").agg(*last), read.groupBy("partition").agg(*last)
    )


@query
def max_lag(spark, sf_dir):
    return audits.max_lag(consumer_lag(spark, sf_dir))


@query
def skew_report(spark, sf_dir):
    return rounded(audits.skew_report(event_readings(spark, sf_dir), SERIES), "share", "to_mean")


@query
def partition_skew(spark, sf_dir):
    """How evenly the readings spread over twelve partitions by user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    keyed = events.withColumn("partition", F.col("user_id") % 12)
    return rounded(audits.skew_report(keyed, ["partition"]), "share", "to_mean")


@query
def target_rate(spark, sf_dir):
    events = channel_readings(spark, sf_dir)
    seen = catalogue.sensor_catalogue(spark, 100).join(
        events.select("sensor_id").distinct(), "sensor_id", "left_semi"
    )
    cars_seen = events.agg(F.countDistinct("car_id")).first()[0]
    return catalogue.target_rate(seen, cars_seen, 1.5)


@query
def scaled_channel_rates(spark, sf_dir):
    counted = audits.count_by_sensor(channel_readings(spark, sf_dir))
    scaled = catalogue.scale_rate(catalogue.sensor_catalogue(spark, 60), 2.0, 3.0)
    rows = scaled.join(counted, "sensor_id", "left")
    return rows.withColumn("readings", F.coalesce("readings", F.lit(0)))


# --- wire -------------------------------------------------------------------------


def _records(events: DataFrame, wire_format: str) -> DataFrame:
    encoded = wire.encode(events, wire_format, keep=("arrival", "event_time"))
    return encoded.select(
        "key", "value", topics.partition_of().alias("partition"),
        F.col("arrival").alias("offset"), F.col("event_time").cast("timestamp").alias("timestamp"),
    )


def _round_trip(spark: SparkSession, sf_dir: str, wire_format: str) -> DataFrame:
    records = _records(event_readings(spark, sf_dir), wire_format)
    return zoneless(wire.good_readings(wire.decode(records, wire_format))).select(
        "car_id", "sensor_id", "event_time", "value", "sequence_no", "ts_ns_remainder"
    )


@query
def protobuf_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "protobuf")


@query
def json_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "json")


@query
def wire_size_audit(spark, sf_dir):
    return rounded(
        wire.wire_size_audit(event_readings(spark, sf_dir)), "protobuf_per_event", "json_per_event", "ratio"
    )


@query
def dead_letter_counts(spark, sf_dir):
    """Payloads of one sensor lose their last byte on the way."""
    records = _records(event_readings(spark, sf_dir), "protobuf")
    binary = F.col("value")
    cut = F.when(
        F.instr(F.hex("value"), F.hex(F.lit("error"))) > 0, F.substring(binary, 1, F.octet_length(binary) - 1)
    ).otherwise(binary)
    decoded = wire.decode(records.withColumn("value", cut))
    return decoded.groupBy("error").agg(F.count(F.lit(1)).alias("records"))


@query
def event_time_fallback(spark, sf_dir):
    """JSON records without a time take the time they were appended."""
    events = event_readings(spark, sf_dir)
    bare = F.to_json(
        F.struct(
            F.col("car_id").alias("carId"), F.col("sensor_id").alias("sensorId"),
            "value", F.col("sequence_no").alias("sequenceNo"),
        )
    )
    records = events.select(
        F.col("car_id").alias("key"), bare.cast("binary").alias("value"),
        F.lit(0).alias("partition"), F.col("arrival").alias("offset"),
        F.col("event_time").cast("timestamp").alias("timestamp"),
    )
    decoded = wire.good_readings(wire.decode(records, "json"))
    return zoneless(decoded.select("car_id", "sensor_id", "event_time", "sequence_no"))


@query
def published_partitions(spark, sf_dir):
    """Each car lands in exactly one partition of the topic."""
    topic = topics.Topic(topics.EVENTS, root=scratch_path(spark, "published"))
    topics.write_events(event_readings(spark, sf_dir), topic)
    return (
        topic.table(spark)
        .groupBy(F.col("key").alias("car_id"))
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.countDistinct("partition").alias("partitions"),
            F.min("offset").alias("first_offset"),
            F.max("offset").alias("last_offset"),
        )
    )


# --- catalogue ----------------------------------------------------------------------


@query
def catalogue_coverage(spark, sf_dir):
    counted = audits.count_by_sensor(channel_readings(spark, sf_dir))
    rows = catalogue.sensor_catalogue(spark, 60).join(counted, "sensor_id", "left")
    return rows.withColumn("readings", F.coalesce("readings", F.lit(0)))


# --- stored tables ------------------------------------------------------------------


def _readings_of(stored: DataFrame) -> DataFrame:
    return rounded(stored.select(*READING_COLUMNS), "value")


@query
def stored_readings(spark, sf_dir):
    return _readings_of(ingested(spark, sf_dir).read("raw"))


@query
def ingest_metrics(spark, sf_dir):
    return ingested(spark, sf_dir).metrics().select("batch_id", "consumed", "written", "duplicates")


@query
def ingest_summary(spark, sf_dir):
    """Counts and batch sizes; the wall-clock columns are left out."""
    return audits.ingest_summary(ingested(spark, sf_dir).metrics()).select(
        "received", "null_records", "dead_letters", "consumed", "written", "duplicates",
        "largest_batch", "batch_p50", "batch_p95",
    )


@query
def record_accounting(spark, sf_dir):
    """What became of every record of a topic on which three in eight are broken."""
    return audits.ingest_summary(accounted(spark, sf_dir).metrics()).select(
        "received", "null_records", "dead_letters", "consumed", "written", "duplicates"
    )


@query
def stored_dead_letters(spark, sf_dir):
    rows = spark.read.parquet(accounted(spark, sf_dir).path("dead_letters"))
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("records"), F.sum("offset").alias("offsets"))


@query
def unkeyed_append(spark, sf_dir):
    path = scratch_path(spark, "unkeyed")
    rows = replayed(spark, sf_dir)
    ingest.append_unkeyed(rows.filter("not replayed"), path)
    ingest.append_unkeyed(rows.filter("replayed"), path)
    return dedupe.integrity_check(spark.read.parquet(path))


@query
def migrated_readings(spark, sf_dir):
    store = new_store(spark, "migrated")
    unkeyed = replayed(spark, sf_dir).withColumnRenamed("arrival", "id").drop("replayed")
    ingest.migrate_to_key(unkeyed, store)
    return _readings_of(store.read("raw")).drop("arrival")


@query
def refreshed_rollup_1m(spark, sf_dir):
    """Two refreshes: the second finds by itself that its chunks have grown into range."""
    store = one_batch(channel_readings(spark, sf_dir), "refresh")
    lifecycle.refresh_rollup_1m(store, "2024-01-01 00:02:30")
    until = newest(store.read("raw"))
    lifecycle.refresh_rollup_1m(store, until)
    return rounded(
        store.rollups().select(*ranges.ROLLUP_COLUMNS), "average", "minimum", "maximum"
    )


@query
def refreshed_rollup_1h(spark, sf_dir):
    source = history(spark, sf_dir)
    store = new_store(spark, "hourly", chunk_hours=24)
    until = newest(source.read("raw"))
    store.write(source.rollups(), "rollup_1m")
    lifecycle.refresh_rollup_1h(store, until)
    return rounded(store.rollups("ONE_HOUR").select(*ranges.ROLLUP_COLUMNS), "average")


def _refreshed_in_steps(spark: SparkSession, sf_dir: str) -> Store:
    """Three batches over several hours, both aggregates refreshed after each, never in full."""

    def build() -> Store:
        store = new_store(spark, "steps")
        rows = spread_readings(spark, sf_dir)
        for number, part in enumerate(slices(rows)):
            ingest.ingest_batch(part, number, store)
            now = newest(part)
            lifecycle.refresh_rollup_1m(store, now)
            lifecycle.refresh_rollup_1h(store, now)
        return store

    return built_once(spark, sf_dir, "steps", build)


@query
def stepwise_rollup_1m(spark, sf_dir):
    store = _refreshed_in_steps(spark, sf_dir)
    return rounded(store.rollups().select(*ranges.ROLLUP_COLUMNS), "average")


@query
def stepwise_rollup_1h(spark, sf_dir):
    store = _refreshed_in_steps(spark, sf_dir)
    return rounded(store.rollups("ONE_HOUR").select(*ranges.ROLLUP_COLUMNS), "average")


def _refreshed_out_of_order(spark: SparkSession, sf_dir: str) -> Store:
    """The same batches under ids that go down, as resumed older checkpoints give them; merged once in between."""

    def build() -> Store:
        store = new_store(spark, "unordered")
        rows = spread_readings(spark, sf_dir)
        until = newest(rows)
        parts = [rows.filter(F.col("sequence_no") % 4 == n) for n in range(4)]
        for number, part in enumerate(parts):
            ingest.ingest_batch(part, 10 - number, store)
            if number == 2:
                lifecycle.compact(store, until)
            chunks = lifecycle.refresh_rollup_1m(store, until, since_batch=10 if number else None)
            lifecycle.refresh_rollup_1h(store, until, chunks)
        return store

    return built_once(spark, sf_dir, "unordered", build)


@query
def unordered_rollup_1m(spark, sf_dir):
    store = _refreshed_out_of_order(spark, sf_dir)
    return rounded(store.rollups().select(*ranges.ROLLUP_COLUMNS), "average")


@query
def unordered_rollup_1h(spark, sf_dir):
    store = _refreshed_out_of_order(spark, sf_dir)
    return rounded(store.rollups("ONE_HOUR").select(*ranges.ROLLUP_COLUMNS), "average")


@query
def backfilled_rollup_1h(spark, sf_dir):
    return rounded(
        history(spark, sf_dir).rollups("ONE_HOUR").select(*ranges.ROLLUP_COLUMNS), "average"
    )


@query
def compacted_readings(spark, sf_dir):
    store = new_store(spark, "compact")
    source = ingested(spark, sf_dir).read("raw")
    store.write(source, "raw")
    lifecycle.compact(store, "9999-01-01 00:00:00")
    return _readings_of(store.read("raw")).withColumn("batches", F.lit(_batch_dirs(store)))


def _batch_dirs(store) -> int:
    return max(map(len, store.batches("raw").values()))


@query
def retained_readings(spark, sf_dir):
    """Raw readings a week of retention leaves, archived first."""
    store = one_batch(event_readings(spark, sf_dir), "retention", chunk_hours=24)
    until = newest(store.read("raw"))
    lifecycle.archive_cold(store, until)
    kept = store.read("raw").withColumn("tier", F.lit("raw"))
    return kept.unionByName(store.read("archive").withColumn("tier", F.lit("archive"))).groupBy(
        "tier", "sensor_id"
    ).agg(
        F.count(F.lit(1)).alias("readings"),
        F.min("event_time").alias("oldest"),
        F.max("event_time").alias("latest"),
    )


@query
def archived_twice(spark, sf_dir):
    """Late readings of a chunk archived before: known ones are refused, new ones archived beside."""
    store = one_batch(event_readings(spark, sf_dir), "archived", chunk_hours=24)
    until = newest(store.read("raw"))
    lifecycle.archive_cold(store, until)
    late = event_readings(spark, sf_dir).filter(F.col("sequence_no") % 5 == 0)
    moved = late.filter(F.col("sequence_no") % 10 == 0).withColumn("car_id", F.lit("CAR-77"))
    ingest.ingest_batch(late.unionByName(moved), 1, store)
    lifecycle.archive_cold(store, until)
    return store.read("archive").groupBy("batch_id", "car_id").agg(
        F.count(F.lit(1)).alias("readings"), F.sum("sequence_no").alias("numbers")
    )


@query
def storage_report(spark, sf_dir):
    """Rows of each table; of files and bytes, which depend on the run, that there are any."""
    store = history(spark, sf_dir)
    report = lifecycle.storage_report(
        store, {name: store.path(name) for name in ("raw", "rollup_1m", "rollup_1h")}
    )
    return report.select("layout", "rows", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


# --- streams ------------------------------------------------------------------------


def _published_by(run: LiveRun) -> DataFrame:
    """The rollups of a run's one topic."""
    rows = wire.json_to_rollups(run.rollups.table(run.spark))
    return rounded(zoneless(rows.drop("arrived_at")), "average", "minimum", "maximum")


@query
def stream_rollups_1s(spark, sf_dir):
    return rollups.of_length(_published_by(live_run(spark, sf_dir)))


@query
def stream_rollups_1m(spark, sf_dir):
    return rollups.of_length(_published_by(live_run(spark, sf_dir)), "1 minute")


@query
def stream_alerts(spark, sf_dir):
    rows = wire.json_to_alerts(live_run(spark, sf_dir).alerts.table(spark))
    return rounded(zoneless(rows.drop("arrived_at")), "observed_maximum")


@query
def stream_session_stats(spark, sf_dir):
    stats = live.current_session(spark, f"{live_run(spark, sf_dir).root}/session")
    return rounded(stats, "peak", "mean")


@query
def stream_ingest(spark, sf_dir):
    stored = Store(spark, f"{live_run(spark, sf_dir).root}/store").read("raw")
    return _readings_of(zoneless(stored)).drop("arrival")


SHORT = "2 seconds"


def _late_run(spark: SparkSession, sf_dir: str, distinct: bool) -> LiveRun:
    """A dropout's replay against a grace too short for it, with or without ``start_distinct``."""

    def build() -> LiveRun:
        run = LiveRun(spark, "late")
        once = topics.Topic(topics.EVENTS, root=f"{run.root}/distinct")
        Files(spark).make(once.path)
        steps = [
            lambda: live.start_rollups(
                run.readings(once if distinct else None), "1 second", SHORT, run.rollups, f"{run.root}/c1",
                availableNow=True,
            )
        ]
        if distinct:
            steps.insert(
                0, lambda: live.start_distinct(run.readings(), SHORT, once, f"{run.root}/c0", availableNow=True)
            )
        run.feed(around_replay(replayed(spark, sf_dir)), steps)
        return run

    return built_once(spark, sf_dir, f"late-{distinct}", build)


@query
def stream_late_rollups(spark, sf_dir):
    """Readings that come after their window has closed are left out."""
    return _published_by(_late_run(spark, sf_dir, False))


@query
def stream_dedup_rollups(spark, sf_dir):
    """The same with every reading taken once: late ones are left out all the same."""
    return _published_by(_late_run(spark, sf_dir, True))


@query
def stream_dropped(spark, sf_dir):
    """How many readings the late rule of the rollup query has dropped."""
    dropped = _late_run(spark, sf_dir, False).dropped[0]
    return spark.range(1).select(F.lit(dropped).cast("bigint").alias("dropped"))


# --- streams with state of their own ------------------------------------------------


def _exact_run(spark: SparkSession, sf_dir: str) -> str:
    """A dropout's replay under the exact late rule, in micro-batches that hold early and late readings alike."""

    def build() -> str:
        run = LiveRun(spark, "exact")
        run.feed(
            slices(replayed(spark, sf_dir).drop("replayed")),
            [
                lambda: stateful.start_exact_rollups(
                    run.readings(), "1 second", SHORT, f"{run.root}/log", f"{run.root}/c1", "car_id", availableNow=True
                )
            ],
        )
        return f"{run.root}/log"

    return built_once(spark, sf_dir, "exact", build)


@query
def exact_stream_rollups(spark, sf_dir):
    """Final rollups of the readings that ``late_audit`` finds on time."""
    rows = stateful.exact_rollups(spark, _exact_run(spark, sf_dir))
    return rounded(zoneless(rows), "average", "minimum", "maximum")


@query
def exact_stream_late(spark, sf_dir):
    """Late readings as the stream's own state has counted them."""
    return zoneless(stateful.late_reports(spark, _exact_run(spark, sf_dir)))


def _view_run(spark: SparkSession, sf_dir: str) -> LiveRun:
    """Rollups and alerts that come in three parts; changes, history and board follow each."""

    def build() -> LiveRun:
        run = LiveRun(spark, "views")
        run.rollups = topics.Topic(topics.ROLLUPS, root=run.root)
        rows = published(spark, sf_dir).withColumn("arrived_at", F.col("window_end"))
        found = late_arrivals(alerts.alerts_for(rows, alert_rules(spark, RULES)))
        once, run.boards = {"availableNow": True}, []
        seen = alerts.alerts_for(rows, alert_rules(spark, RULES), ("arrived_at",))
        ordered = topics.Topic(topics.ALERTS, root=f"{run.root}/ordered")
        for part, raised_part, late_part in zip(
            thirds(rows, "window_end"), _same_thirds(rows, seen), thirds(found, "arrived_at")
        ):
            run.rollups.append(as_records(part, wire.rollups_to_json))
            ordered.append(as_records(raised_part, wire.alerts_to_json))
            run.alerts.append(as_records(late_part, wire.alerts_to_json))
            # Each of these is one pass over what is new; none reads the topic again.
            for query_ in (
                stateful.start_changes(
                    stateful.signal_changes(of_seconds(topics.read_rollups(spark, run.rollups)), "speed", PATIENCE),
                    f"{run.root}/signal", f"{run.root}/c1", **once,
                ),
                stateful.start_changes(
                    stateful.breach_changes(topics.read_alerts(spark, ordered), PATIENCE),
                    f"{run.root}/breach", f"{run.root}/c2", **once,
                ),
                views.start_alert_history(
                    topics.read_alerts(spark, run.alerts), 200, f"{run.root}/history", f"{run.root}/c3", **once
                ),
                views.start_live_board(
                    topics.read_rollups(spark, run.rollups), f"{run.root}/board", f"{run.root}/c4", **once
                ),
                views.start_breaches(topics.read_alerts(spark, ordered), f"{run.root}/breaches", f"{run.root}/c5", **once),
            ):
                query_.awaitTermination()
            now = newest(of_seconds(part), "window_end")
            run.boards.append(
                views.current_board(spark, f"{run.root}/board", f"{run.root}/breaches", now).collect()
            )
        return run

    return built_once(spark, sf_dir, "views", build)


PATIENCE = "10 seconds"
of_seconds = rollups.of_length


def _same_thirds(rows: DataFrame, found: DataFrame) -> list[DataFrame]:
    """Alerts cut where the rollups are."""
    ends = [newest(part, "window_end") for part in thirds(rows, "window_end")]
    cuts = [None, *ends[:-1], None]
    parts = []
    for after, until in zip(cuts, cuts[1:]):
        part = found if after is None else found.filter(F.col("window_end") > F.lit(after))
        parts.append(part if until is None else part.filter(F.col("window_end") <= F.lit(until)))
    return parts


@query
def stream_signal_changes(spark, sf_dir):
    """When each car's signal came and was lost, from timers."""
    return zoneless(spark.read.parquet(f"{_view_run(spark, sf_dir).root}/signal"))


@query
def stream_breach_changes(spark, sf_dir):
    """When each car's active breach became another one or was over, from timers."""
    return rounded(zoneless(spark.read.parquet(f"{_view_run(spark, sf_dir).root}/breach")), "observed_maximum")


@query
def recent_alerts_by_arrival(spark, sf_dir):
    """The newest alerts in the order they came in, which isn't that of their windows."""
    rows = views.current(spark, f"{_view_run(spark, sf_dir).root}/history")
    return rounded(zoneless(alerts.recent_alerts(rows, 200, "arrived_at")), "observed_maximum")


@query
def breach_list_by_arrival(spark, sf_dir):
    rows = views.current(spark, f"{_view_run(spark, sf_dir).root}/history")
    return rounded(zoneless(alerts.recent_alerts(rows, 100, "arrived_at")), "observed_maximum")


@query
def stream_board(spark, sf_dir):
    """The live board after each of three parts of the stream, from views that saw each rollup once."""
    boards = _view_run(spark, sf_dir).boards
    names = live_board(spark, sf_dir).schema
    rows = [(slice_, *row) for slice_, board_ in enumerate(boards, 1) for row in board_]
    schema = "slice int, " + ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in names)
    order = ["slice", *names.names]
    columns = ["slice", *(boards[0][0].__fields__ if boards[0] else names.names)]
    frame = spark.createDataFrame([tuple(row[columns.index(name)] for name in order) for row in rows], schema)
    return rounded(
        frame, "speed", "engine_rpm", "throttle", "brake", "average_speed", "top_speed", "brake_fl_peak", "breach_observed"
    )


@query
def session_after_lost_checkpoint(spark, sf_dir):
    """Statistics whose query lost its checkpoint between two parts and read everything again."""

    def build() -> str:
        run = LiveRun(spark, "lost")
        run.rollups = topics.Topic(topics.ROLLUPS, root=run.root)
        for number, part in enumerate(thirds(second_rows(spark, sf_dir).withColumn("arrived_at", F.col("window_end")), "window_end")):
            run.rollups.append(as_records(part, wire.rollups_to_json))
            live.start_session_stats(
                topics.read_rollups(spark, run.rollups), f"{run.root}/session", f"{run.root}/c{number > 1}", availableNow=True
            ).awaitTermination()
        return f"{run.root}/session"

    stats = live.current_session(spark, built_once(spark, sf_dir, "lost", build))
    return rounded(stats, "peak", "mean")


@query
def stream_from_latest(spark, sf_dir):
    """What a reader gets that subscribed after the first third of the topic, and was stopped between the others."""

    def build() -> str:
        run = LiveRun(spark, "latest")
        events = channel_readings(spark, sf_dir)
        third = (newest(events, "arrival") or 0) // 3
        turn = F.when(F.col("arrival") <= third, 0).when(F.col("arrival") <= 2 * third, 1).otherwise(2)
        for part in range(3):
            topics.write_events(events.filter(turn == part), run.events)
            decoded = topics.read_events(spark, run.events, starting="latest", group="reader")
            reader = wire.good_readings(decoded).writeStream.option("checkpointLocation", f"{run.root}/checkpoint")
            reader.format("parquet").option("path", f"{run.root}/read").trigger(availableNow=True).start().awaitTermination()
        return f"{run.root}/read"

    got = spark.read.parquet(built_once(spark, sf_dir, "latest", build))
    return rounded(zoneless(got.select("car_id", "sensor_id", "event_time", "value", "sequence_no")), "value")


@query
def not_found_rule(spark, sf_dir):
    """Series asked for by name: those with minutes in the range, and those that are refused as not found."""
    minutes = history(spark, sf_dir).read("rollup_1m")
    answers = []
    for sensor_id in ("click", "view", "no-such-sensor"):
        start, end = "2024-01-08 00:00:00", "2024-01-12 00:00:00"
        try:
            found = ranges.find_rollups(minutes, "CAR-01", sensor_id, start, end, on_empty="raise")
        except ranges.NothingFound:
            found = minutes.limit(0)
        answers.append(found.agg(F.lit(sensor_id).alias("sensor_id"), F.count(F.lit(1)).alias("rows")))
    every = answers[0].unionByName(answers[1]).unionByName(answers[2])
    return every.withColumn("found", F.col("rows") > 0)


@query
def created_empty(spark, sf_dir):
    """Rows of each table as created, and after a second creation over a filled store."""
    fresh, filled = new_store(spark, "fresh"), history(spark, sf_dir).create()
    counts = [
        store.read(name).agg(F.lit(name).alias("name"), F.lit(when).alias("state"), F.count(F.lit(1)).alias("rows"))
        for store, when in ((fresh, "new"), (filled, "again"))
        for name in ("raw", "rollup_1m", "rollup_1h")
    ]
    every = counts[0]
    for count in counts[1:]:
        every = every.unionByName(count)
    return every
