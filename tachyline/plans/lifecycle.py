"""Keeping the tables: refresh, compaction, archive, retention, size report."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tachyline.functions.time import at, ceil_to, floor_to, instant, time_bucket
from tachyline.operators.rollups import finished, merged_states, minute_states, rollup_1h, rollup_1m
from tachyline.plans import manifest
from tachyline.plans.files import Files, chunk_dir, hours_code, side_by_side
from tachyline.plans.sizing import broadcast_if_small
from tachyline.plans.store import FILE_OPTIONS, MOST_REBALANCED, Coverage, Store, salt, tasks_for
from tachyline.schemas import small_table

HOUR = dt.timedelta(hours=1)
REFRESH_SPAN = dt.timedelta(days=7)
RETENTION = dt.timedelta(days=7)
COMPACT_AFTER = dt.timedelta(hours=1)
#: Parts of partial states per chunk that a refresh reads before it writes them as one.
MOST_PARTS = 16
#: Directories of single batches, and of merged ones, that an open chunk may hold before they are merged.
MOST_BATCHES = 32
MOST_MERGED = 8


def _bounded(rows: DataFrame, column: str, low: dt.datetime, high: dt.datetime) -> DataFrame:
    return rows.filter((F.col(column) >= at(rows, column, low)) & (F.col(column) < at(rows, column, high)))


def _outside(rows: DataFrame, column: str, low: dt.datetime, high: dt.datetime) -> DataFrame:
    return rows.filter((F.col(column) < at(rows, column, low)) | (F.col(column) >= at(rows, column, high)))


def _batches(store: Store, start: dt.datetime) -> list[int]:
    """Ids of the batch directories of a chunk."""
    return [held.batch for held in store.directories("raw", [start])]


def _newest_batch(batches: list[int]) -> int:
    """The newest batch among ``batches``, seen through compaction.

    Compaction of batches up to n leaves a directory named -(n + 1): no retried batch
    can overwrite it, and it still says how recent its rows are.
    """
    return max((-batch - 1 if batch < 0 else batch for batch in batches), default=-1)


def newest_stored_batch(store: Store) -> int:
    """The newest batch id any stored reading or metrics row carries; -1 when none does."""
    recorded = [int(name.split("=")[1]) for name in Files(store.spark).children(store.path("metrics")) if "=" in name]
    return max([*recorded, _newest_batch([held.batch for held in store.directories("raw")])])


def dirty_chunks(store: Store, since_batch: int) -> list[dt.datetime]:
    """Chunks of the raw table that a batch after ``since_batch`` has written to.

    Directory names alone: this is the invalidation log of the aggregates.
    """
    return [start for start, batches in store.batches("raw").items() if _newest_batch(batches) > since_batch]


def refresh_rollup_1m(
    store: Store, now: str | dt.datetime, since_batch: int | None = None, full: bool = False
) -> list[dt.datetime]:
    """Bring the one-minute buckets in [now - 7 d, now - 1 min) up to date with the raw readings.

    Beside the aggregate stand partial states (count, sum, least, greatest) and, per chunk, the set of
    batches they hold. A refresh reads the batches that are not among them, in whatever order ids were
    given, and adds their states; only a chunk whose known batches are gone (merged by another writer) is
    read again as a whole. A chunk is due if it holds other batches than its states, if its states are newer
    than its rows, or if its rows end before the part of the chunk that is now in range; others aren't read.
    ``since_batch`` also takes chunks that hold a newer batch, ``full`` reads every chunk again.
    Only whole buckets are published, and only of chunks that still have raw data, so
    aggregates outlive the readings they came from. Existing buckets of a boundary chunk that
    lie outside the range are carried over. Returns the chunks that were rewritten.
    """
    now = instant(now)
    low, high = ceil_to(now - REFRESH_SPAN, "1 minute"), floor_to(now - dt.timedelta(minutes=1), "1 minute")
    store.recover("rollup_1m")
    store.recover_shared("raw")
    marks, coverage = store.marks("rollup_1m"), store.coverage()
    chunks, unread = [], {}
    within = [start for start in store.chunks("raw") if start + store.chunk > low and start < high]
    stored = store.batches("raw", within)
    for start in within:
        batches = frozenset(stored.get(start, ()))
        held = coverage.get(start, Coverage())
        revision, bound = marks.get(start, (-1, dt.datetime.min))
        named = full or (since_batch is not None and _newest_batch(batches) > since_batch)
        if not (named or batches != held.batches or held.revision != revision or bound < min(start + store.chunk, high)):
            continue
        chunks.append(start)
        if full or not held.parts or not held.batches <= batches:
            coverage[start] = held = Coverage(held.revision)
        if batches != held.batches:
            unread[start] = batches - held.batches
    if not chunks:
        return []
    if unread:
        coverage |= _add_states(store, unread, coverage)
        store.set_coverage({start: held for start, held in coverage.items() if start + store.chunk > low})
    parts = {start: coverage[start].parts for start in chunks}
    states = store.read_parts("rollup_1m_states", "part", parts)
    fresh = _bounded(finished(merged_states(states)), "bucket", low, high)
    edges = [start for start in chunks if start < low or start + store.chunk > high]
    kept = _outside(store.read_chunks("rollup_1m", edges), "bucket", low, high).select(*fresh.columns)
    _write_minutes(store, fresh.unionByName(kept), len(chunks))
    done = {start: (coverage[start].revision, min(start + store.chunk, high)) for start in chunks}
    _mark(store, "rollup_1m", marks | done, low)
    _drop_other_parts(store, {start: coverage[start].parts for start in unread})
    return chunks


def _add_states(
    store: Store, unread: dict[dt.datetime, frozenset[int]], coverage: dict[dt.datetime, Coverage]
) -> dict[dt.datetime, Coverage]:
    """Write the states of unread batches as a part of a new number; many old parts become one with it.

    A part counts once the coverage names it: what a crash leaves behind is never read.
    """
    part = uuid.uuid4().int >> 65
    states = minute_states(store.read_parts("raw", "batch_id", unread))
    joined = {start: coverage[start].parts for start in unread if len(coverage[start].parts) >= MOST_PARTS}
    if joined:
        old = store.read_parts("rollup_1m_states", "part", joined).select(*states.columns)
        states = merged_states(states.unionByName(old))
    rows = store.with_bucket_chunk(states).withColumn("part", F.lit(part))
    store.write(rows, "rollup_1m_states", salt(4, "car_id", "sensor_id"), directories=len(unread))
    return {
        start: Coverage(
            coverage[start].revision + 1,
            coverage[start].batches | batches,
            (part,) if start in joined else (*coverage[start].parts, part),
        )
        for start, batches in unread.items()
    }


def _drop_other_parts(store: Store, parts: dict[dt.datetime, tuple[int, ...]]) -> None:
    files = Files(store.spark)

    def drop(chunk: tuple[dt.datetime, tuple[int, ...]]) -> None:
        root = store.chunk_path("rollup_1m_states", chunk[0])
        for name in files.children(root):
            if name.startswith("part=") and int(name.split("=")[1]) not in chunk[1]:
                files.delete(f"{root}/{name}")

    side_by_side(drop, parts.items())


def _mark(
    store: Store, table: str, marks: dict[dt.datetime, tuple[int, dt.datetime]], low: dt.datetime
) -> None:
    """Keep the marks of chunks that a later refresh can still reach."""
    store.set_marks(table, {start: mark for start, mark in marks.items() if start + store.chunk > low})


def _write_minutes(store: Store, minutes: DataFrame, chunks: int) -> None:
    store.replace(store.with_bucket_chunk(minutes), "rollup_1m", salt(4, "car_id", "sensor_id"), chunks)


def refresh_rollup_1h(
    store: Store, now: str | dt.datetime, chunks: list[dt.datetime] | None = None
) -> list[dt.datetime]:
    """Bring the one-hour buckets in [now - 7 d, now - 1 h) up to date with the one-minute rows.

    A chunk is due if its one-minute rows have been refreshed since its hours were built, if
    more of it has come into range, or if ``chunks`` names it (what the one-minute refresh
    returned). The other hours of an affected date are carried over.
    """
    now = instant(now)
    low, high = ceil_to(now - REFRESH_SPAN, "1 hour"), floor_to(now - HOUR, "1 hour")
    store.recover("rollup_1h")
    built, minutes, named = store.marks("rollup_1h"), store.marks("rollup_1m"), set(chunks or ())
    progress = store.marks("rollup_1h_source")
    chosen = []
    for start in store.chunks("rollup_1m"):
        if start + store.chunk <= low or start >= high:
            continue
        source, bound = minutes.get(start), built.get(start, (-1, dt.datetime.min))[1]
        behind = source is None or progress.get(start) != source
        if start in named or bound < min(start + store.chunk, high) or (behind and (source or start not in built)):
            chosen.append(start)
    if not chosen:
        return []
    fresh = rollup_1h(_bounded(store.read_chunks("rollup_1m", chosen), "bucket", low, high))
    dates = sorted({start.date() for start in chosen})
    existing = store.read("rollup_1h").filter(F.col("bucket_date").isin(dates))
    starts = [at(existing, "bucket", start) for start in chosen]
    recomputed = (
        time_bucket(f"{store.chunk_hours} hours", "bucket").isin(starts)
        & (F.col("bucket") >= at(existing, "bucket", low))
        & (F.col("bucket") < at(existing, "bucket", high))
    )
    kept = existing.filter(~recomputed).select(*fresh.columns)
    rows = fresh.unionByName(kept).withColumn("bucket_date", F.to_date("bucket"))
    store.replace(rows, "rollup_1h", salt(4, "car_id", "sensor_id"), len(dates))
    sources = {start: minutes[start] for start in chosen if start in minutes}
    _mark(store, "rollup_1h_source", progress | sources, low)
    done = {start: (minutes.get(start, (-1, low))[0], min(start + store.chunk, high)) for start in chosen}
    _mark(store, "rollup_1h", built | done, low)
    return chosen


def backfill(store: Store) -> None:
    """Fill both aggregates from everything the raw table holds.

    What comes later arrives in other batches, so the chunks are marked as done to their ends. They have no
    partial states yet: the first refresh that finds such a batch reads its chunk as a whole.
    """
    store.recover_shared("raw")
    before, stored = store.coverage(), store.batches("raw")
    batches = {start: frozenset(stored.get(start, ())) for start in store.chunks("raw")}
    coverage = {
        start: Coverage(before.get(start, Coverage()).revision + 1, held) for start, held in batches.items()
    }
    marks = {start: (held.revision, start + store.chunk) for start, held in coverage.items()}
    _write_minutes(store, rollup_1m(store.read("raw")), len(batches))
    hourly = rollup_1h(store.read("rollup_1m")).withColumn("bucket_date", F.to_date("bucket"))
    dates = len({start.date() for start in batches})
    store.replace(hourly, "rollup_1h", salt(4, "car_id", "sensor_id"), dates)
    store.set_coverage(before | coverage)
    for table in ("rollup_1m", "rollup_1h_source", "rollup_1h"):
        store.set_marks(table, marks)


def compact(store: Store, now: str | dt.datetime, after: dt.timedelta = COMPACT_AFTER) -> list[dt.datetime]:
    """Merge the batch directories of chunks that closed ``after`` ago.

    Rows are range-partitioned on the full sort key (chunk, car, sensor, newest first),
    so that a series with very many rows is cut by time rather than handed to one task,
    and the sorted files give tight row-group statistics. Each chunk is swapped in by
    rename; a crash in between is repaired by the next run. The merged directory gets a name the
    chunk has not had, so that a refresh can tell it from an older one; where all that was merged is in the
    aggregates' states, they are told so and read nothing again.
    """
    finish_compaction(store)
    files, raw, parking = Files(store.spark), store.path("raw"), _parking(store)
    cut = instant(now) - after
    shared = [held for held in store.directories("raw") if held.shared]
    batches = store.batches("raw")
    closed = {start for start in batches if start + store.chunk <= cut}
    due = {start for start in closed if any(batch >= 0 for batch in batches[start])}
    # Chunks that share directories are merged with all of their date, whose rows are few. An open date's are split.
    sharing = [held for held in shared if not due.isdisjoint(held.chunks)]
    days = {held.day.date() for held in sharing}
    open_days = {start.date() for start in batches.keys() - closed if start.date() in days}
    if open_days:
        store.split("raw", [held for held in sharing if held.day.date() in open_days])
        return compact(store, now, after)
    merged, sources, together = {}, {}, {}
    for start in sorted(due | {start for start in closed if start.date() in days}):
        merged[start] = min(-(_newest_batch(batches[start]) + 1), min(batches[start]) - 1)
        sources[start] = frozenset(batches[start])
        if start.date() in days:
            together.setdefault((start.date(), merged[start]), []).append(start.hour)
    if not merged:
        return []
    closed = list(merged)
    codes = {key: hours_code(hours) for key, hours in together.items()}
    # One row per chunk being merged, made from directory names.
    names = small_table(
        store.spark,
        [
            (start.date(), start.hour, batch, codes.get((start.date(), batch), start.hour))
            for start, batch in merged.items()
        ],
        "event_date date, event_hour int, batch_id bigint, code int",
    )
    staged = f"{parking}/staged-{uuid.uuid4().hex[:12]}"
    order = ["event_date", "event_hour", "batch_id", "car_id", "sensor_id", F.desc("event_time")]
    # Left to itself, adaptive execution goes by bytes: one task would write the files of very many small chunks.
    partitions = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    directories = len(codes) + sum(start.date() not in days for start in closed)
    dealt = [max(tasks_for(directories), partitions), *order] if directories > MOST_REBALANCED else order
    (
        store.read_chunks("raw", closed)
        .drop("batch_id")
        .join(broadcast_if_small(names), ["event_date", "event_hour"])
        .withColumn("event_hour", F.col("code"))
        .drop("code")
        .repartitionByRange(*dealt)
        .sortWithinPartitions(*order)
        .write.options(**FILE_OPTIONS)
        .partitionBy("event_date", "event_hour", "batch_id")
        .parquet(staged)
    )
    manifest.write(store, staged)

    def swap(name: str) -> None:
        parked = f"{parking}/{'old' if '/' in name else 'days'}/{name}"
        files.rename(f"{raw}/{name}", parked)
        files.rename(f"{staged}/{name}", f"{raw}/{name}")
        files.delete(parked)

    alone = [chunk_dir("", start)[1:] for start in closed if start.date() not in days]
    side_by_side(swap, [*alone, *(f"event_date={day:%Y-%m-%d}" for day in sorted(days))])
    files.delete(staged)
    coverage = store.coverage()
    renamed = {
        start: Coverage(coverage[start].revision, frozenset([batch]), coverage[start].parts)
        for start, batch in merged.items()
        if start in coverage and coverage[start].batches == sources[start]
    }
    if renamed:
        store.set_coverage(coverage | renamed)
    return closed


def _parking(store: Store) -> str:
    """Outside the table, so that no reader ever lists half-finished work."""
    return f"{store.root}/compaction"


def finish_compaction(store: Store) -> None:
    """Finish or undo what a crash cut short: swaps of chunks and of dates, splits of shared directories."""
    files, raw, parking = Files(store.spark), store.path("raw"), _parking(store)
    for start in files.chunks(f"{parking}/old"):
        files.finish_swap(chunk_dir(raw, start), chunk_dir(f"{parking}/old", start))
    for day in files.below(f"{parking}/days", "event_date=*"):
        files.finish_swap(f"{raw}/{day}", f"{parking}/days/{day}")
    store.recover_shared("raw")


def crowded(store: Store, chunks: Iterable[dt.datetime], in_flight: int) -> list[dt.datetime]:
    """Chunks among ``chunks`` with enough directories for ``merge_open`` to merge some."""

    def full(batches: list[int]) -> bool:
        single = sum(0 <= batch < in_flight for batch in batches)
        return single > MOST_BATCHES or sum(batch < 0 for batch in batches) > MOST_MERGED

    return [start for start, batches in store.batches("raw", chunks).items() if full(batches)]


def merge_open(store: Store, start: dt.datetime, in_flight: int) -> list[int]:
    """Merge the small directories of a chunk that is still written to, so that a batch never lists many.

    Two levels: more than ``MOST_BATCHES`` directories of single batches become one, and more than ``MOST_MERGED``
    of those become one again, so a row is rewritten a few times however many batches an hour has. Batches
    from ``in_flight`` on stay: they may come again and replace their own output. What the aggregates' states hold
    is merged apart from what they don't, so a refresh still reads new rows only. Returns what was merged.
    """
    finish_merges(store)
    store.recover_shared("raw")
    batches = _batches(store, start)
    for level, most in (([b for b in batches if 0 <= b < in_flight], MOST_BATCHES), ([b for b in batches if b < 0], MOST_MERGED)):
        if len(level) > most:
            held = store.coverage().get(start, Coverage()).batches
            sources = max([b for b in level if b in held], [b for b in level if b not in held], key=len)
            if len(sources) > 1:
                shared = [other for other in store.directories("raw", [start]) if other.shared]
                store.split("raw", [other for other in shared if other.batch in sources])
                _merge(store, start, sources, min(-(_newest_batch(sources) + 1), min(batches) - 1, -1))
                return sources
    return []


def _intent(start: dt.datetime, sources: list[int], target: int, staged: str) -> str:
    return json.dumps({"chunk": start.isoformat(), "sources": sorted(sources), "target": target, "staged": staged})


def _merge(store: Store, start: dt.datetime, sources: list[int], target: int) -> None:
    files, name = Files(store.spark), uuid.uuid4().hex[:12]
    staged = f"{store.root}/merges/staged-{name}"
    (
        store.read_parts("raw", "batch_id", {start: sources})
        .drop("event_date", "event_hour", "batch_id")
        .hint("rebalance", "car_id", "sensor_id")
        .sortWithinPartitions("car_id", "sensor_id", "event_time")
        .write.options(**FILE_OPTIONS)
        .parquet(staged)
    )
    files.write_text(f"{store.root}/merges/intent-{name}", _intent(start, sources, target, staged))
    files.rename(staged, f"{store.chunk_path('raw', start)}/batch_id={target}")
    finish_merges(store)


def finish_merges(store: Store) -> None:
    """Take merged sources away, or give up a merge that a crash stopped before it stood in the table."""
    files, root = Files(store.spark), f"{store.root}/merges"
    for name in files.children(root):
        if not name.startswith("intent-"):
            continue
        intent = json.loads(files.read_text(f"{root}/{name}"))
        start, sources = dt.datetime.fromisoformat(intent["chunk"]), frozenset(intent["sources"])
        folder = store.chunk_path("raw", start)
        if files.exists(f"{folder}/batch_id={intent['target']}"):
            coverage = store.coverage()
            held = coverage.get(start, Coverage())
            if sources <= held.batches:
                batches = held.batches - sources | {intent["target"]}
                store.set_coverage(coverage | {start: Coverage(held.revision, batches, held.parts)})
            for source in sources:
                files.delete(f"{folder}/batch_id={source}")
        files.delete(intent["staged"])
        files.delete(f"{root}/{name}")
    for name in files.children(root):
        files.delete(f"{root}/{name}")


def _expired(store: Store, now: str | dt.datetime, keep: dt.timedelta) -> list[dt.datetime]:
    cut = instant(now) - keep
    return [start for start in store.chunks("raw") if start + store.chunk <= cut]


def apply_retention(
    store: Store, now: str | dt.datetime, keep: dt.timedelta = RETENTION
) -> list[dt.datetime]:
    """Drop raw chunks that ended ``keep`` ago, by directory. Aggregates stay."""
    finish_compaction(store)
    dropped = _expired(store, now, keep)
    store.drop_chunks("raw", dropped)
    return dropped


def archive_cold(
    store: Store, now: str | dt.datetime, keep: dt.timedelta = RETENTION
) -> list[dt.datetime]:
    """Copy expiring raw chunks to the archive, compare counts, then drop them.

    Chunk and batch are compared: late readings of a chunk archived before come in a batch of
    their own, beside what the archive has already.
    """
    finish_compaction(store)
    cold = _expired(store, now, keep)
    if not cold:
        return []
    source = store.read_chunks("raw", cold)
    store.write(source, "archive", salt(8, "car_id", "sensor_id", "event_time"), directories=len(cold))
    by_chunk = ["event_date", "event_hour", "batch_id"]
    copied = store.read_chunks("archive", cold).groupBy(*by_chunk).agg(F.count(F.lit(1)).alias("copied"))
    counts = source.groupBy(*by_chunk).agg(F.count(F.lit(1)).alias("held"))
    short = counts.join(copied, by_chunk, "left").filter(F.coalesce("copied", F.lit(0)) != F.col("held"))
    if not short.isEmpty():
        raise ValueError("archived chunks do not match the raw table; nothing was dropped")
    return apply_retention(store, now, keep)


def storage_report(store: Store, tables: dict[str, str]) -> DataFrame:
    """Files, bytes and rows of each named directory of Parquet files.

    Rows come from the file footers, sizes from file metadata; no column is read.
    """
    spark = store.spark
    parts = []
    for name, path in tables.items():
        files = (
            spark.read.parquet(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
            .groupBy("file", "size")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        parts.append(
            files.agg(
                F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("n").alias("rows")
            ).select(F.lit(name).alias("layout"), "files", "bytes", "rows")
        )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.withColumn("bytes_per_row", F.col("bytes") / F.col("rows"))
