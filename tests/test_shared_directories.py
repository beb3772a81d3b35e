"""Readings of few rows in very many chunks: the chunks of a date share a batch directory."""

import datetime as dt

import pytest

from helpers import W, readings, values
from tachyline.operators import dedupe
from tachyline.plans import ingest, lifecycle, manifest
from tachyline.plans import store as stores
from tachyline.plans.files import Files, chunks_of, hours_code
from tachyline.plans.store import Store
from tachyline.workload import queries

HOUR = dt.timedelta(hours=1)
CHUNKS = 150
END = W + CHUNKS * HOUR


@pytest.fixture
def store(spark, place):
    return Store(spark, place).create()


def hourly(spark, offset=0, chunks=CHUNKS):
    """One reading an hour, ``offset`` seconds after it begins; the value is the hour's number."""
    return readings(spark, [("CAR-01", "speed", 3600 * n + offset, n) for n in range(chunks)])


def held(store):
    return values(store.read("raw"), "event_time", "value")


def hours_agree(store):
    rows = store.read("raw").select("event_time", "event_date", "event_hour").collect()
    return all((row[0].date(), row[0].hour) == (row[1], row[2]) for row in rows)


def test_codes_name_their_hours():
    day = dt.datetime(2026, 8, 23)
    for hours in ([0], [23], [0, 1], [5, 7, 23], list(range(24))):
        assert chunks_of(day, hours_code(hours)) == [day + hour * HOUR for hour in hours]


def test_many_chunks_of_few_readings_share_directories(spark, store):
    assert ingest.ingest_batch(hourly(spark), 0, store) == (CHUNKS, CHUNKS)
    directories = store.directories("raw")
    assert len(directories) < 35 and len(store.read("raw").inputFiles()) < CHUNKS // 2
    # The newest date is still written to: its chunks have their own.
    newest = max(found.day for found in directories)
    assert {found.shared for found in directories if found.day == newest} == {False}
    assert {found.shared for found in directories if found.day < newest} == {True}
    assert len(held(store)) == CHUNKS and hours_agree(store)
    chunks = [W + n * HOUR for n in range(CHUNKS)]
    assert store.chunks() == chunks and store.batches("raw") == {start: [0] for start in chunks}
    for some in (chunks, chunks[:30], chunks[5:6], chunks[::2], chunks[-3:]):
        found = store.read_chunks("raw", some).select("event_time", "event_hour").collect()
        assert sorted(row[0] for row in found) == some and all(row[0].hour == row[1] for row in found)
        parts = store.read_parts("raw", "batch_id", {start: [0, 7] for start in some})
        assert values(parts, "event_time") == some


def test_a_batch_replaces_itself_and_rejects_what_is_stored(spark, store):
    ingest.ingest_batch(hourly(spark), 4, store)
    assert ingest.ingest_batch(hourly(spark), 4, store) == (CHUNKS, CHUNKS)
    assert ingest.ingest_batch(hourly(spark), 2, store) == (CHUNKS, 0)
    assert ingest.ingest_batch(hourly(spark, 7), 1, store) == (CHUNKS, CHUNKS)
    # The same batch again with readings of other chunks, few enough for directories of their own.
    assert ingest.ingest_batch(hourly(spark, chunks=20), 4, store) == (20, 20)
    assert dedupe.integrity_check(store.read("raw")).first()["duplicates"] == 0
    assert len(held(store)) == 2 * CHUNKS and hours_agree(store)


def test_dense_chunks_keep_their_own(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "SPARSE_ROWS", 1)
    ingest.ingest_batch(hourly(spark), 0, store)
    assert not any(found.shared for found in store.directories("raw")) and len(store.directories("raw")) == CHUNKS


def test_compaction_merges_dates_and_splits_an_open_one(spark, store):
    for batch, offset in ((9, 0), (8, 1), (7, 2)):
        ingest.ingest_batch(hourly(spark, offset), batch, store)
    rows = held(store)
    now = W + 80 * HOUR + HOUR
    merged = lifecycle.compact(store, now)
    assert merged == [W + n * HOUR for n in range(80)]
    assert held(store) == rows and hours_agree(store)
    batches = store.batches("raw")
    assert all((batches[start] == [-10]) == (start < W + 80 * HOUR) for start in store.chunks())
    assert len(store.directories("raw")) < 150
    assert lifecycle.compact(store, now) == []
    # Late readings of a merged date: it is merged again, with nothing lost or twice.
    assert ingest.ingest_batch(hourly(spark, 3, 30), 3, store) == (30, 30)
    assert set(lifecycle.compact(store, END + 2 * HOUR)) >= {W + n * HOUR for n in (*range(30), *range(80, CHUNKS))}
    assert len(held(store)) == 3 * CHUNKS + 30 and hours_agree(store)
    assert all(len(some) == 1 and some[0] < 0 for some in store.batches("raw").values())
    assert not Files(spark).children(f"{store.root}/compaction/days")


@pytest.mark.parametrize("staged_in", [False, True])
def test_a_crash_while_a_date_is_swapped_is_repaired(spark, store, staged_in):
    ingest.ingest_batch(hourly(spark), 0, store)
    rows, files = held(store), Files(spark)
    live, parked = (f"{root}/event_date={W:%Y-%m-%d}" for root in (store.path("raw"), f"{store.root}/compaction/days"))
    copy = f"{store.root}/copy"
    spark.read.parquet(live).drop("event_hour", "batch_id").write.parquet(copy)
    files.rename(live, parked)
    if staged_in:
        files.rename(copy, f"{live}/event_hour={hours_code(range(12, 24))}/batch_id=-1")
    # A batch into that date comes before the next compaction.
    assert ingest.ingest_batch(hourly(spark, 5, 2), 1, store) == (2, 2)
    assert len(held(store)) == len(rows) + 2 and not files.exists(parked)


@pytest.mark.parametrize("moved", [0, 1])
def test_a_crash_during_a_split_is_undone(spark, store, moved):
    ingest.ingest_batch(hourly(spark), 0, store)
    rows, files = held(store), Files(spark)
    shared = next(found for found in store.directories("raw") if found.shared)
    live, parked = f"{store.path('raw')}/{shared.name}", f"{store.root}/swap/shared/raw/{shared.name}"
    for start in shared.chunks[:moved]:
        store.read_chunks("raw", [start]).drop("event_date", "event_hour", "batch_id").write.parquet(
            f"{store.chunk_path('raw', start)}/batch_id=0"
        )
    files.rename(live, parked)
    lifecycle.refresh_rollup_1m(store, END)
    assert held(store) == rows and not files.exists(parked) and shared in store.directories("raw")


def test_retention_and_archive_take_a_part_of_a_date(spark, store):
    ingest.ingest_batch(hourly(spark), 0, store)
    now = W + 20 * HOUR + lifecycle.RETENTION
    cold = [W + n * HOUR for n in range(20)]
    assert lifecycle.archive_cold(store, now) == cold
    assert values(store.read("archive"), "event_time") == cold
    assert store.chunks() == [W + n * HOUR for n in range(20, CHUNKS)]
    assert len(held(store)) == CHUNKS - 20 and hours_agree(store)
    # What is archived counts as stored.
    assert ingest.ingest_batch(hourly(spark), 1, store) == (CHUNKS, 0)


def test_aggregates_and_series_read_shared_directories(spark, store):
    for batch, offset in ((9, 0), (8, 1)):
        ingest.ingest_batch(hourly(spark, offset), batch, store)
        assert len(lifecycle.refresh_rollup_1m(store, END)) == CHUNKS
        lifecycle.refresh_rollup_1h(store, END + HOUR)
    assert lifecycle.refresh_rollup_1m(store, END) == []
    lifecycle.compact(store, END + 2 * HOUR)
    assert lifecycle.refresh_rollup_1m(store, END) == []
    expected = [(W + n * HOUR, 2, float(n)) for n in range(CHUNKS)]
    assert values(store.rollups(), "bucket", "samples", "average") == expected
    assert values(store.rollups("ONE_HOUR"), "bucket", "samples", "average") == expected
    low, high = W + 3 * HOUR, W + 40 * HOUR
    found = values(manifest.read_series(store, "CAR-01", "speed", low, high), "event_time")
    assert found == sorted(low + n * HOUR + second * dt.timedelta(seconds=1) for n in range(37) for second in (0, 1))
    paths, _, known = manifest.files_of(store, "CAR-01", "speed", low, high)
    assert known and len(paths) == len(set(paths)) and manifest.files_of(store, "CAR-02", "speed", low, high)[0] == []


def test_a_crowded_chunk_leaves_its_shared_directories(spark, store, monkeypatch):
    monkeypatch.setattr(lifecycle, "MOST_BATCHES", 2)
    for batch in range(3):
        ingest.ingest_batch(hourly(spark, batch), batch, store)
    rows = held(store)
    assert lifecycle.crowded(store, [W], 3) == [W]
    assert sorted(lifecycle.merge_open(store, W, 3)) == [0, 1, 2]
    assert held(store) == rows and hours_agree(store)
    assert store.batches("raw")[W] == [-3] and sorted(store.batches("raw")[W + HOUR]) == [0, 1, 2]


def test_chunks_without_a_reading_are_not_made_up(spark, store):
    some = [n for n in range(800) if n % 24 in (3, 4, 17, 22)]
    ingest.ingest_batch(readings(spark, [("CAR-01", "speed", 3600 * n, n) for n in some]), 0, store)
    assert any(found.shared for found in store.directories("raw"))
    assert store.chunks() == [W + n * HOUR for n in some] and hours_agree(store)


def test_the_unordered_refresh_writes_few_directories(spark, place):
    """Four readings in each of 160 hours, one for each of the query's batches; rows against a plain fold.

    A refresh takes the last seven days.
    """
    ids = [514 * n + k for n in (*range(140), *range(400, 420)) for k in range(4)]
    rows = [(n, dt.datetime(2024, 1, 1), n % 3, "click", float(n % 50), None) for n in ids]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{place}/events.parquet")
    found = queries.unordered_rollup_1m(spark, place)
    start, expected = dt.datetime(2024, 1, 1), {}
    end = (start + dt.timedelta(seconds=7 * max(ids), minutes=-1)).replace(second=0)
    for n in ids:
        bucket = (start + dt.timedelta(seconds=7 * n)).replace(second=0)
        if end - lifecycle.REFRESH_SPAN < bucket < end:
            expected.setdefault((f"CAR-{n % 3 + 1:02d}", bucket), []).append(float(n % 50))
    got = {(row["car_id"], row["bucket"]): (row["samples"], row["average"], row["minimum"], row["maximum"]) for row in found.collect()}
    assert got == {
        key: (len(some), pytest.approx(sum(some) / len(some), abs=1e-6), min(some), max(some)) for key, some in expected.items()
    }
    # Three batches were merged, the fourth came after: by the date, but for the newest.
    raw = queries._refreshed_out_of_order(spark, place).directories("raw")
    assert len(raw) < 160 // 2
