import datetime as dt

import pytest

from helpers import W, readings, speed, values
from tachyline.operators import dedupe
from tachyline.operators.rollups import rollup_1m
from tachyline.plans import ingest, lifecycle, manifest
from tachyline.plans.files import Files
from tachyline.plans.store import Store

HOUR = dt.timedelta(hours=1)
MINUTE = dt.timedelta(minutes=1)


@pytest.fixture
def store(spark, place):
    return Store(spark, place).create()


def buckets(store, resolution="ONE_MINUTE"):
    return values(store.rollups(resolution), "bucket", "samples", "average")


def test_tables_start_empty(store):
    assert store.read("raw").isEmpty() and store.rollups().isEmpty() and store.rollups("ONE_HOUR").isEmpty()
    assert lifecycle.refresh_rollup_1m(store, W) == []
    assert lifecycle.refresh_rollup_1h(store, W) == []
    assert lifecycle.compact(store, W) == []


def test_refresh_stops_a_minute_before_now(spark, store):
    ingest.ingest_batch(readings(spark, [speed(60 * n + 1, n) for n in range(5)]), 0, store)
    lifecycle.refresh_rollup_1m(store, W + dt.timedelta(minutes=4, seconds=30))
    assert [row[0] for row in buckets(store)] == [W, W + MINUTE, W + 2 * MINUTE]


def test_refresh_keeps_buckets_outside_its_range(spark, store):
    """A refresh seven days later must not lose the older half of its first hour."""
    ingest.ingest_batch(readings(spark, [speed(60 * n + 1, n) for n in range(5)]), 0, store)
    lifecycle.refresh_rollup_1m(store, W + HOUR)
    before = buckets(store)
    ingest.ingest_batch(readings(spark, [speed(122, 100)]), 1, store)
    lifecycle.refresh_rollup_1m(store, W + lifecycle.REFRESH_SPAN + 2 * MINUTE)
    after = buckets(store)
    assert after[:2] == before[:2] and after[3:] == before[3:]
    assert after[2] == (W + 2 * MINUTE, 2, 51.0)


def test_aggregates_outlive_dropped_readings(spark, store):
    ingest.ingest_batch(readings(spark, [speed(1, 1), speed(3601, 2)]), 0, store)
    lifecycle.backfill(store)
    before = buckets(store)
    assert lifecycle.apply_retention(store, W + lifecycle.RETENTION + HOUR) == [W]
    assert values(store.read("raw"), "value") == [2.0]
    lifecycle.refresh_rollup_1m(store, W + lifecycle.RETENTION + HOUR)
    assert buckets(store) == before


def test_a_narrow_refresh_sees_only_what_changed(spark, store):
    ingest.ingest_batch(readings(spark, [speed(3600 * n, n) for n in range(3)]), 0, store)
    now = W + 4 * HOUR
    lifecycle.refresh_rollup_1m(store, now)
    ingest.ingest_batch(readings(spark, [speed(3601, 9)]), 1, store)
    assert lifecycle.refresh_rollup_1m(store, now, since_batch=0) == [W + HOUR]
    assert buckets(store)[1] == (W + HOUR, 2, 5.0)


def test_a_running_hour_stays_complete(spark, store):
    """What a refresh had to leave out is due again, though no newer batch has touched the chunk."""
    half = dt.timedelta(seconds=30)
    ingest.ingest_batch(readings(spark, [speed(28 * 60, 1), speed(30 * 60 + 30, 2)]), 0, store)
    assert lifecycle.refresh_rollup_1m(store, W + 30 * MINUTE + half + MINUTE / 6) == [W]
    assert [row[0] for row in buckets(store)] == [W + 28 * MINUTE]
    ingest.ingest_batch(readings(spark, [speed(160 * 60, 3)]), 1, store)
    assert lifecycle.refresh_rollup_1m(store, W + 161 * MINUTE) == [W, W + 2 * HOUR]
    assert [row[0] for row in buckets(store)] == [W + 28 * MINUTE, W + 30 * MINUTE]
    assert lifecycle.refresh_rollup_1m(store, W + 161 * MINUTE) == []
    assert lifecycle.refresh_rollup_1m(store, W + 400 * MINUTE) == [W + 2 * HOUR]
    lifecycle.refresh_rollup_1h(store, W + 400 * MINUTE)
    assert buckets(store, "ONE_HOUR") == [(W, 2, 1.5), (W + 2 * HOUR, 1, 3.0)]
    assert lifecycle.refresh_rollup_1h(store, W + 400 * MINUTE) == []
    assert lifecycle.refresh_rollup_1m(store, W + 400 * MINUTE, full=True) == [W, W + 2 * HOUR]


def test_a_batch_with_a_lower_id_is_not_lost(spark, store):
    """Two checkpoints with ranges of their own, the older one resumed after the newer."""
    now = W + 3 * HOUR
    ingest.ingest_batch(readings(spark, [speed(1, 1)]), 10, store)
    lifecycle.refresh_rollup_1m(store, now)
    lifecycle.refresh_rollup_1h(store, now)
    for n, batch in enumerate((5, 20, 7)):
        ingest.ingest_batch(readings(spark, [speed(1200 + n, 50 + n)]), batch, store)
        chunks = lifecycle.refresh_rollup_1m(store, now)
        assert chunks == [W] and lifecycle.refresh_rollup_1h(store, now) == [W]
        assert buckets(store)[1][1] == n + 1
        assert buckets(store, "ONE_HOUR")[0][1] == n + 2
    assert lifecycle.refresh_rollup_1m(store, now) == [] and lifecycle.refresh_rollup_1h(store, now) == []


def test_a_compacted_chunk_takes_lower_ids_too(spark, store):
    now = W + 3 * HOUR
    ingest.ingest_batch(readings(spark, [speed(1, 1)]), 10, store)
    lifecycle.refresh_rollup_1m(store, now)
    assert lifecycle.compact(store, now) == [W] and lifecycle.refresh_rollup_1m(store, now) == []
    ingest.ingest_batch(readings(spark, [speed(2, 3)]), 5, store)
    # merged before the refresh has seen it: the merged directory has a name of its own
    assert lifecycle.compact(store, now) == [W]
    assert Files(spark).children(store.chunk_path("raw", W)) == ["batch_id=-12"]
    assert lifecycle.refresh_rollup_1m(store, now) == [W]
    assert buckets(store) == [(W, 2, 2.0)]
    ingest.ingest_batch(readings(spark, [speed(3, 5)]), 6, store)
    assert lifecycle.refresh_rollup_1m(store, now) == [W] and buckets(store) == [(W, 3, 3.0)]


def test_a_refresh_reads_new_batches_only(spark, store, monkeypatch):
    """What a batch brought is kept as partial states: its readings aren't opened again."""
    monkeypatch.setattr(lifecycle, "MOST_PARTS", 3)
    files = Files(spark)
    for batch in range(8):
        ingest.ingest_batch(readings(spark, [speed(60 * batch + n, 10 * batch + n) for n in range(3)]), batch, store)
        lifecycle.refresh_rollup_1m(store, W + 30 * MINUTE)
        folder = f"{store.chunk_path('raw', W)}/batch_id={batch}"
        for name in files.children(folder):
            files.delete(f"{folder}/{name}")
        assert len(store.coverage()[W].parts) <= 3
        assert len(files.children(store.chunk_path("rollup_1m_states", W))) <= 3
    assert buckets(store) == [(W + n * MINUTE, 3, 10.0 * n + 1) for n in range(8)]


def test_states_that_were_not_published_are_due(spark, store, monkeypatch):
    """A crash between the states and the rows, and one between writing states and naming them."""
    ingest.ingest_batch(readings(spark, [speed(1, 1)]), 0, store)
    lifecycle.refresh_rollup_1m(store, W + HOUR)
    ingest.ingest_batch(readings(spark, [speed(2, 3)]), 1, store)

    def crash(*_):
        raise OSError("lost")

    for place in ("_write_minutes", "_mark"):
        with monkeypatch.context() as patched:
            patched.setattr(lifecycle, place, crash)
            with pytest.raises(OSError):
                lifecycle.refresh_rollup_1m(store, W + HOUR)
    with monkeypatch.context() as patched:
        patched.setattr(Store, "set_coverage", crash)
        ingest.ingest_batch(readings(spark, [speed(3, 5)]), 2, store)
        with pytest.raises(OSError):
            lifecycle.refresh_rollup_1m(store, W + HOUR)
    assert lifecycle.refresh_rollup_1m(store, W + HOUR) == [W]
    assert buckets(store) == [(W, 3, 3.0)] and lifecycle.refresh_rollup_1m(store, W + HOUR) == []


@pytest.mark.parametrize("staged_in", [False, True])
def test_a_crash_during_a_refresh_is_repaired(spark, store, staged_in):
    ingest.ingest_batch(readings(spark, [speed(1, 1)]), 0, store)
    lifecycle.backfill(store)
    before, files = buckets(store), Files(spark)
    live = store.chunk_path("rollup_1m", W)
    parked = live.replace(store.path("rollup_1m"), f"{store.root}/swap/rollup_1m")
    if staged_in:
        copy = store.rollups().drop("bucket_date", "bucket_hour").collect()
        schema = store.rollups().drop("bucket_date", "bucket_hour").schema
        files.rename(live, parked)
        spark.createDataFrame(copy, schema).write.parquet(live)
    else:
        files.rename(live, parked)
        assert store.rollups().isEmpty()
    lifecycle.refresh_rollup_1m(store, W + HOUR)
    assert buckets(store) == before and not files.exists(parked)


def test_marks_survive_an_incomplete_version(spark, store):
    store.set_marks("rollup_1m", {W: (3, W + MINUTE)})
    Files(spark).make(f"{store.root}/refreshed/rollup_1m/version=000000000009")
    assert store.marks("rollup_1m") == {W: (3, W + MINUTE)}
    store.set_marks("rollup_1m", {W: (4, W + HOUR)})
    assert store.marks("rollup_1m") == {W: (4, W + HOUR)}


def test_late_readings_of_an_archived_chunk_are_archived_too(spark, store):
    ingest.ingest_batch(readings(spark, [speed(1, 1), speed(2, 2)]), 0, store)
    now = W + lifecycle.RETENTION + HOUR
    assert lifecycle.archive_cold(store, now) == [W]
    assert ingest.ingest_batch(readings(spark, [speed(1, 9), speed(3, 3)]), 1, store) == (2, 1)
    assert lifecycle.archive_cold(store, now) == [W]
    assert values(store.read("archive"), "value") == [1.0, 2.0, 3.0]
    assert store.read("raw").isEmpty()


def test_compaction_does_not_hide_a_change_from_the_refresh(spark, store):
    ingest.ingest_batch(readings(spark, [speed(1, 1)]), 0, store)
    ingest.ingest_batch(readings(spark, [speed(3601, 2)]), 1, store)
    lifecycle.compact(store, W + 5 * HOUR)
    assert lifecycle.dirty_chunks(store, 0) == [W + HOUR]
    assert lifecycle.dirty_chunks(store, -1) == [W, W + HOUR]


def test_hours_are_weighted_and_others_of_the_date_stay(spark, store):
    rows = [speed(1, 10)] + [speed(60 + n, 20) for n in range(3)] + [speed(3601, 5)]
    ingest.ingest_batch(readings(spark, rows), 0, store)
    lifecycle.backfill(store)
    assert buckets(store, "ONE_HOUR") == [(W, 4, 17.5), (W + HOUR, 1, 5.0)]
    ingest.ingest_batch(readings(spark, [speed(3602, 15)]), 1, store)
    chunks = lifecycle.refresh_rollup_1m(store, W + 4 * HOUR, since_batch=0)
    assert lifecycle.refresh_rollup_1h(store, W + 4 * HOUR, chunks) == [W + HOUR]
    assert buckets(store, "ONE_HOUR") == [(W, 4, 17.5), (W + HOUR, 2, 10.0)]


def test_the_current_hour_is_left_to_a_later_refresh(spark, store):
    ingest.ingest_batch(readings(spark, [speed(1, 10), speed(3601, 5)]), 0, store)
    lifecycle.refresh_rollup_1m(store, W + 2 * HOUR)
    lifecycle.refresh_rollup_1h(store, W + 2 * HOUR + 30 * MINUTE - HOUR)
    assert buckets(store, "ONE_HOUR") == []
    lifecycle.refresh_rollup_1h(store, W + 2 * HOUR)
    assert buckets(store, "ONE_HOUR") == [(W, 1, 10.0)]


def test_compaction_keeps_every_row_once(spark, store):
    for batch in range(3):
        ingest.ingest_batch(readings(spark, [speed(10 * batch + n, n) for n in range(15)]), batch, store)
    rows = values(store.read("raw"), "event_time", "value")
    assert lifecycle.compact(store, W + 30 * MINUTE) == []
    assert lifecycle.compact(store, W + 2 * HOUR) == [W]
    assert values(store.read("raw"), "event_time", "value") == rows
    assert Files(store.spark).children(store.chunk_path("raw", W)) == ["batch_id=-3"]
    assert lifecycle.compact(store, W + 2 * HOUR) == []
    ingest.ingest_batch(readings(spark, [speed(0, 9), speed(500, 9)]), 3, store)
    assert dedupe.integrity_check(store.read("raw")).first()["duplicates"] == 0
    assert lifecycle.compact(store, W + 2 * HOUR) == [W]
    assert store.read("raw").count() == len(rows) + 1


@pytest.mark.parametrize("staged_in", [False, True])
def test_a_crash_during_the_swap_is_repaired(spark, store, staged_in):
    ingest.ingest_batch(readings(spark, [speed(1, 1), speed(2, 2)]), 0, store)
    files, live = Files(spark), store.chunk_path("raw", W)
    old = f"{store.root}/compaction/old/event_date={W:%Y-%m-%d}/event_hour={W.hour}"
    if staged_in:
        rows = store.read("raw").withColumnRenamed("batch_id", "was").collect()
        copy = spark.createDataFrame([tuple(row)[:6] for row in rows], "car_id string, sensor_id string, event_time timestamp, value double, sequence_no bigint, arrival bigint")
        files.rename(live, old)
        copy.write.parquet(f"{live}/batch_id=-1")
    else:
        files.rename(live, old)
        assert store.read("raw").isEmpty()
    lifecycle.compact(store, W)
    assert values(store.read("raw"), "value") == [1.0, 2.0]
    assert not files.exists(old)


def test_the_archive_is_checked_before_anything_is_dropped(spark, store, monkeypatch):
    ingest.ingest_batch(readings(spark, [speed(1, 1), speed(3601, 2)]), 0, store)
    now = W + lifecycle.RETENTION + HOUR
    monkeypatch.setattr(Store, "write", lambda *args, **kwargs: None)
    with pytest.raises(ValueError):
        lifecycle.archive_cold(store, now)
    monkeypatch.undo()
    assert store.read("raw").count() == 2
    assert lifecycle.archive_cold(store, now) == [W]
    assert values(store.read("archive"), "value") == [1.0] and values(store.read("raw"), "value") == [2.0]
    assert lifecycle.archive_cold(store, now) == []


def test_storage_report_counts_files_bytes_and_rows(spark, store):
    ingest.ingest_batch(readings(spark, [speed(n, n) for n in range(50)]), 0, store)
    lifecycle.backfill(store)
    report = lifecycle.storage_report(store, {name: store.path(name) for name in ("raw", "rollup_1m")})
    rows = {row["layout"]: row for row in report.collect()}
    assert (rows["raw"]["rows"], rows["rollup_1m"]["rows"]) == (50, 1)
    assert all(row["bytes"] > 0 and row["files"] >= 1 for row in rows.values())


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from tachyline.plans.files import scratch_path

    class Conf:
        def get(self, *_):
            return None

        def set(self, *_):
            pass

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://cluster:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        scratch_path(Session(), "x")
    Session.sparkContext.master = "local[2]"
    assert "tachyline" in scratch_path(Session(), "x")


def test_a_slice_opens_only_the_files_that_can_hold_it(spark, store, monkeypatch):
    """Series and times outside a file's bounds leave it alone; batches after the merge are read as well."""
    rows = [(f"CAR-{car:02d}", "speed", n, car * 100 + n) for car in range(1, 9) for n in range(0, 3600, 60)]
    ingest.ingest_batch(readings(spark, rows), 0, store)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lifecycle.compact(store, W + 5 * HOUR)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.read("raw").count() == len(rows)
    every = {name for name in Files(spark).children(store.chunk_path("raw", W) + "/batch_id=-1") if name.endswith(".parquet")}
    assert len(every) > 2
    start, end = W + 10 * MINUTE, W + 20 * MINUTE
    paths, size, known = manifest.files_of(store, "CAR-03", "speed", start, end)
    assert 1 <= len(paths) < len(every) and size > 0 and known
    expected = [(start + n * MINUTE, 300.0 + 600 + 60 * n) for n in range(10)]
    found = manifest.read_series(store, "CAR-03", "speed", start, end)
    assert values(found, "event_time", "value") == expected
    plan = rollup_1m(found)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert manifest.read_series(store, "CAR-77", "speed", start, end).isEmpty()
    assert manifest.files_of(store, "CAR-77", "speed", start, end)[0] == []
    ingest.ingest_batch(readings(spark, [("CAR-03", "speed", 605, 5), ("CAR-03", "speed", 4000, 6)]), 1, store)
    late = manifest.read_series(store, "CAR-03", "speed", start, end)
    assert values(late, "event_time", "value") == sorted(expected + [(W + dt.timedelta(seconds=605), 5.0)])
    assert manifest.read_series(store, "CAR-03", "speed", W + HOUR, W + 2 * HOUR).count() == 1
    assert manifest.read_series(store, "CAR-03", "speed", end, start).isEmpty()


def test_an_open_hour_keeps_few_directories(spark, store, monkeypatch):
    """Batch after batch into one hour: directories and files stay bounded, rows and aggregates whole."""
    monkeypatch.setattr(lifecycle, "MOST_BATCHES", 4)
    monkeypatch.setattr(lifecycle, "MOST_MERGED", 2)
    files, folders, rows = Files(spark), [], 0
    for batch in range(16):
        # one known reading and one new one each time
        ingest.ingest_batch(readings(spark, [speed(0, 0), speed(batch + 1, batch)]), batch, store, writers_per_chunk=1)
        rows += 2 if batch == 0 else 1
        folders.append(len(files.children(store.chunk_path("raw", W))))
        if batch in (5, 9):
            lifecycle.refresh_rollup_1m(store, W + HOUR)
            assert buckets(store)[0][1] == rows
    assert max(folders) <= 4 + 2 + 2 and store.read("raw").count() == rows
    assert dedupe.integrity_check(store.read("raw")).first()["duplicates"] == 0
    # the retry of the newest batch replaces its own output, merged or not around it
    assert ingest.ingest_batch(readings(spark, [speed(0, 0), speed(16, 15)]), 15, store) == (2, 1)
    assert store.read("raw").count() == rows
    monkeypatch.setattr(lifecycle, "MOST_PARTS", 1)
    read = []
    monkeypatch.setattr(Store, "read_parts", lambda self, table, column, parts, real=Store.read_parts: (
        read.append((table, parts)), real(self, table, column, parts))[1])
    assert lifecycle.refresh_rollup_1m(store, W + HOUR) == [W] and buckets(store)[0][1] == rows
    # what the refresh had seen before was merged apart from what it hadn't: only that is read
    (unread,) = [parts[W] for table, parts in read if table == "raw"]
    assert 0 < len(unread) < len(lifecycle._batches(store, W))


@pytest.mark.parametrize("swapped", [False, True])
def test_a_crash_during_a_merge_is_repaired(spark, store, swapped):
    for batch in range(3):
        ingest.ingest_batch(readings(spark, [speed(batch, batch)]), batch, store)
    files, folder = Files(spark), store.chunk_path("raw", W)
    merged = f"{store.root}/merges/staged-x"
    store.read_parts("raw", "batch_id", {W: [0, 1]}).drop("batch_id", "event_date", "event_hour").write.parquet(merged)
    files.write_text(f"{store.root}/merges/intent-x", lifecycle._intent(W, [0, 1], -5, merged))
    if swapped:
        files.rename(merged, f"{folder}/batch_id=-5")
    lifecycle.finish_merges(store)
    assert values(store.read("raw"), "value") == [0.0, 1.0, 2.0]
    assert files.children(folder) == (["batch_id=-5", "batch_id=2"] if swapped else ["batch_id=0", "batch_id=1", "batch_id=2"])
    assert files.children(f"{store.root}/merges") == []


def test_rows_of_many_chunks_are_written_by_several_tasks(spark, place):
    """One file per small chunk, not all of them by one task; whole dates and single chunks read the same rows."""
    store = Store(spark, place).create()
    assert ingest.ingest_batch(readings(spark, [("CAR-01", "speed", 3600 * n, n) for n in range(80)]), 0, store) == (80, 80)
    names = [name.rsplit("/", 1)[1] for name in store.read("raw").inputFiles()]
    assert len(names) == 80 and len({name.split("-")[1] for name in names}) > 1
    chunks = store.chunks()
    for some in (chunks, chunks[:30], chunks[5:6], chunks[::2]):
        found = store.read_chunks("raw", some).select("event_time").collect()
        assert sorted(row[0].replace(minute=0, second=0) for row in found) == sorted(some)
