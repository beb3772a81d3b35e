import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import W, formatted_plan, readings, speed, values
from tachyline.operators import audits, dedupe
from tachyline.plans import ingest
from tachyline.plans.store import Store


def thousand(spark):
    return readings(spark, [(f"CAR-{n % 20 + 1:02d}", "speed", n / 1000, 210.5) for n in range(1000)])


def counts(store):
    row = dedupe.integrity_check(store.read("raw")).first()
    return row["rows"], row["distinct_readings"], row["duplicates"]


@pytest.fixture
def store(spark, place):
    return Store(spark, place).create()


def test_replays_leave_one_row_per_reading(spark, store):
    events = thousand(spark)
    assert ingest.ingest_batch(events, 0, store) == (1000, 1000)
    assert ingest.ingest_batch(events, 1, store) == (1000, 0)
    assert ingest.ingest_batch(events.filter("sequence_no < 200"), 2, store) == (200, 0)
    assert counts(store) == (1000, 1000, 0)


def test_duplicates_are_counted(spark, store):
    events = readings(spark, [speed(n / 100, n) for n in range(220)] + [speed(n / 100, n) for n in range(30)])
    assert ingest.ingest_batch(events, 0, store) == (250, 220)
    row = store.metrics().first()
    assert (row["consumed"], row["written"], row["duplicates"]) == (250, 220, 30)
    assert audits.ingest_summary(store.metrics()).first()["duplicates"] == 30


def test_an_empty_batch_writes_nothing(spark, store):
    assert ingest.ingest_batch(thousand(spark).limit(0), 0, store) == (0, 0)
    assert store.chunks() == [] and store.read("raw").isEmpty()


def test_the_first_arrival_wins(spark, store):
    ingest.ingest_batch(readings(spark, [speed(1, 1.0), speed(1, 2.0)]), 0, store)
    ingest.ingest_batch(readings(spark, [speed(1, 9.0)]), 1, store)
    assert values(store.read("raw"), "value") == [1.0]


def test_retries_change_nothing(spark, store):
    one = readings(spark, [speed(1, 1), speed(2, 2), speed(4000, 3)])
    two = readings(spark, [speed(2, 7), speed(3, 4)])
    ingest.ingest_batch(one, 1, store)
    ingest.ingest_batch(two, 2, store)
    before = values(store.read("raw"), "event_time", "value", "batch_id")
    for events, batch in ((two, 2), (one, 1), (two, 2)):
        ingest.ingest_batch(events, batch, store)
    assert values(store.read("raw"), "event_time", "value", "batch_id") == before


def test_a_batch_over_many_chunks_finds_all_that_is_stored(spark, store):
    events = readings(spark, [speed(7200 * n + 60 * n, n) for n in range(24)])
    assert ingest.ingest_batch(events, 0, store) == (24, 24)
    assert ingest.ingest_batch(events, 1, store) == (24, 0)


def test_spans_cover_every_chunk_and_are_few():
    hour = dt.timedelta(hours=1)
    touched = {W + n * 5 * hour: (W + n * 5 * hour, W + n * 5 * hour + hour / 2) for n in range(40)}
    spans = ingest.time_spans(touched, hour)
    assert len(spans) == ingest.MOST_SPANS
    assert all(any(a <= low and high <= b for a, b in spans) for low, high in touched.values())
    near = {W: (W, W + hour / 2), W + hour: (W + hour, W + hour * 1.5)}
    assert ingest.time_spans(near, hour) == [(W, W + hour * 1.5)]


def test_a_batch_reads_only_its_own_times(spark, store):
    """Both bounds reach the reader, so twenty batches into one hour each read about one batch."""
    for batch in range(3):
        ingest.ingest_batch(readings(spark, [speed(60 * batch + n, n) for n in range(20)]), batch, store)
    low = W + dt.timedelta(minutes=2)
    keys = ingest._stored_keys(store, {W: (low, low + dt.timedelta(seconds=19))}, 9)
    plan = formatted_plan(keys)
    assert "GreaterThanOrEqual(event_time" in plan and "LessThanOrEqual(event_time" in plan
    assert values(keys, "event_time") == [low + dt.timedelta(seconds=n) for n in range(20)]


def test_metrics_account_for_every_record(spark, store):
    ingest.ingest_batch(thousand(spark).limit(0), 3, store, null_records=2, dead_letters=5)
    ingest.ingest_batch(thousand(spark), 4, store, null_records=1)
    got = values(store.metrics(), "batch_id", "received", "null_records", "dead_letters", "consumed")
    assert got == [(3, 7, 2, 5, 0), (4, 1001, 1, 0, 1000)]
    summary = audits.ingest_summary(store.metrics()).first()
    assert (summary["received"], summary["dead_letters"], summary["batch_p50"]) == (1008, 5, 500.0)


def test_only_the_touched_chunks_are_read(spark, store):
    ingest.ingest_batch(readings(spark, [speed(3600 * n, n) for n in range(3)]), 0, store)
    keys = ingest._stored_keys(store, {W: (W, W + dt.timedelta(minutes=59))}, 1)
    files = {row[0] for row in keys.select(F.input_file_name()).collect()}
    assert all(f"event_hour={W.hour}" in name for name in files) and files


def test_existing_duplicates_keep_the_lowest_id(spark):
    table = readings(spark, [speed(1, 5.0), speed(1, 6.0), speed(2, 7.0)]).withColumnRenamed("arrival", "id")
    assert values(dedupe.dedupe_existing(table), "value") == [5.0, 7.0]


def test_migration_keys_an_unkeyed_table(spark, store, place):
    events = thousand(spark)
    path = f"{place}/unkeyed"
    ingest.append_unkeyed(events, path)
    ingest.append_unkeyed(events.filter("sequence_no < 200"), path)
    unkeyed = spark.read.parquet(path)
    assert dedupe.integrity_check(unkeyed).first()["duplicates"] == 200
    assert dedupe.duplicated_readings(unkeyed).count() == 200
    numbered = unkeyed.withColumn("id", F.monotonically_increasing_id()).drop("arrival")
    assert ingest.migrate_to_key(numbered, store).first()["rows"] == 1000


def test_audit_counts_rejections(spark):
    events = readings(spark, [speed(1, 1), speed(1, 1), speed(2, 2)])
    got = values(dedupe.replay_audit(events), "layout", "written", "rejected", "duplicates_stored")
    assert got == [("keyed", 2, 1, 0), ("unkeyed", 3, 0, 1)]


def test_first_arrival_aggregates_before_the_shuffle(spark):
    plan = dedupe.first_arrival(thousand(spark))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_a_store_may_have_longer_chunks(spark, place):
    store = Store(spark, place, chunk_hours=6).create()
    ingest.ingest_batch(readings(spark, [speed(3600 * n, n) for n in range(12)]), 0, store)
    assert [start.hour for start in store.chunks()] == [12, 18]
    assert dataclasses.replace(store, chunk_hours=1).chunk == dt.timedelta(hours=1)
