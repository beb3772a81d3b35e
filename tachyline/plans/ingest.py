"""Idempotent ingest: at-least-once delivery in, one row per reading stored."""

from __future__ import annotations

import datetime as dt
import time
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from tachyline.functions.time import at, micros
from tachyline.operators.dedupe import dedupe_existing, first_arrival, integrity_check, reject_stored
from tachyline.plans.lifecycle import crowded, finish_compaction, finish_merges, merge_open
from tachyline.plans.store import READING_COLUMNS, Store, salt, shared_codes
from tachyline.schemas import INGEST_METRIC, KEY, small_table

WRITERS_PER_CHUNK = 8
MOST_SPANS = 16
EPOCH = dt.datetime(1970, 1, 1)

Span = tuple[dt.datetime, dt.datetime]


def time_spans(touched: dict[dt.datetime, Span], step: dt.timedelta) -> list[Span]:
    """Event times of a batch as a few closed intervals.

    Neighbouring chunks' intervals are joined; if there are still more than ``MOST_SPANS``, so
    are those with the smallest gaps. Wider intervals read more and find the same.
    """
    spans: list[list[dt.datetime]] = []
    for low, high in sorted(touched.values()):
        if spans and low - spans[-1][1] <= step:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    while len(spans) > MOST_SPANS:
        at = min(range(len(spans) - 1), key=lambda i: spans[i + 1][0] - spans[i][1])
        spans[at : at + 2] = [[spans[at][0], spans[at + 1][1]]]
    return [(low, high) for low, high in spans]


def _stored_keys(store: Store, touched: dict[dt.datetime, Span], batch_id: int) -> DataFrame:
    """Keys of the touched chunks written by other batches, raw or archived.

    Only the chunks' own directories are listed, and the batch's event times reach the
    reader: files of a running hour are narrow in time, so a batch skips nearly all of them.
    """
    spans = time_spans(touched, store.chunk)
    frames = []
    for table in ("raw", "archive"):
        stored = store.read_chunks(table, list(touched))
        inside = [
            (F.col("event_time") >= at(stored, "event_time", low)) & (F.col("event_time") <= at(stored, "event_time", high))
            for low, high in spans
        ]
        # Not its own half-written output, should this be the retry of a failed batch.
        kept = stored.filter(reduce(or_, inside)).filter(F.col("batch_id") != batch_id)
        frames.append(kept.select(*KEY))
    return frames[0].unionByName(frames[1])


def ingest_batch(
    events: DataFrame,
    batch_id: int,
    store: Store,
    writers_per_chunk: int = WRITERS_PER_CHUNK,
    null_records: int = 0,
    dead_letters: int = 0,
) -> tuple[int, int]:
    """Store the readings of one batch that are not stored yet.

    Within the batch the first arrival of a reading wins; against the table the
    stored one does, also where it has been archived. Running the same batch again replaces
    exactly its own output, so a retry after a lost executor or driver changes nothing.
    Returns (consumed, written) and appends a metrics row, in which ``received`` also counts the
    records that held no reading.
    """
    started = time.monotonic()
    dated = store.with_event_chunk(events.select(*READING_COLUMNS))
    instants = micros("event_time")
    rows = dated.groupBy("event_date", "event_hour").agg(
        F.count(F.lit(1)).alias("n"), F.min(instants).alias("low"), F.max(instants).alias("high")
    ).collect()
    consumed, written = sum(row["n"] for row in rows), 0
    if consumed:
        touched = {
            dt.datetime.combine(row["event_date"], dt.time(row["event_hour"])): (
                EPOCH + dt.timedelta(microseconds=row["low"]), EPOCH + dt.timedelta(microseconds=row["high"])
            )
            for row in rows
        }
        finish_compaction(store)
        finish_merges(store)
        for start in crowded(store, touched, batch_id):
            merge_open(store, start, batch_id)
        first = first_arrival(events.select(*READING_COLUMNS))
        fresh = store.with_event_chunk(reject_stored(first, _stored_keys(store, touched, batch_id)))
        codes = shared_codes(store, touched, consumed)
        if codes:
            names = small_table(store.spark, sorted(codes.items()), "event_date date, code int")
            fresh = fresh.join(F.broadcast(names), "event_date", "left")
            fresh = fresh.withColumn("event_hour", F.coalesce("code", "event_hour")).drop("code")
        # What an earlier attempt left under other names is not overwritten.
        own = [held for held in store.directories("raw", touched) if held.batch == batch_id]
        other = [held for held in own if held.code != codes.get(held.day.date(), held.code if not held.shared else None)]
        if other:
            store.drop_chunks("raw", {start for held in other for start in held.chunks if start in touched}, batch_id)
        store.write(
            fresh.withColumn("batch_id", F.lit(batch_id).cast("bigint")),
            "raw",
            salt(writers_per_chunk, *KEY),
            directories=len(codes) + sum(start.date() not in codes for start in touched),
            n_rows=consumed,
        )
        # Counted from what was committed: task retries cannot inflate it.
        written = store.read_chunks("raw", list(touched)).filter(F.col("batch_id") == batch_id).count()
    received = consumed + null_records + dead_letters
    if received:
        elapsed = (time.monotonic() - started) * 1000
        row = (batch_id, received, null_records, dead_letters, consumed, written, consumed - written, elapsed)
        metrics = small_table(events.sparkSession, [row], INGEST_METRIC)
        metrics.write.mode("overwrite").parquet(f"{store.path('metrics')}/batch={batch_id}")
    return consumed, written


def append_unkeyed(events: DataFrame, path: str) -> None:
    """Plain append without a key; duplicates stay. The control group of the audits."""
    events.write.mode("append").parquet(path)


def migrate_to_key(unkeyed: DataFrame, store: Store, row_id: str = "id") -> DataFrame:
    """Rewrite an unkeyed table under the natural key and check the result.

    Raises if a reading is still stored twice; returns the integrity row.
    """
    keyed = dedupe_existing(unkeyed, row_id)
    if "arrival" not in keyed.columns:
        keyed = keyed.withColumn("arrival", F.col("sequence_no"))
    rows = store.with_event_chunk(keyed.select(*READING_COLUMNS)).withColumn("batch_id", F.lit(-1).cast("bigint"))
    store.write(rows, "raw", salt(WRITERS_PER_CHUNK, *KEY))
    check = integrity_check(store.read("raw"))
    if check.first()["duplicates"]:
        raise ValueError("the migrated table still holds duplicate readings")
    return check
