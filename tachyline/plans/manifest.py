"""Which files of a compacted chunk can hold a series and a time: read instead of every file's footer.

Compaction cuts a chunk along (car, sensor, time), so each of its files holds a narrow range of that order. The
manifest is a small text file in the merged batch directory, one line per file with its bounds. It is written
before the directory is swapped in, so the two are never apart; its name begins with an underscore, which
readers of the table pass over. Batches that came after the merge have none: their directories are read as before.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, functions as F

from tachyline.functions.time import at, instant, micros
from tachyline.plans.files import Files, side_by_side
from tachyline.plans.store import Store

NAME = "_manifest.json"
EPOCH = dt.datetime(1970, 1, 1)
#: A slice of up to this many files and bytes is read by one task, without an exchange behind it.
ONE_TASK_FILES, ONE_TASK_BYTES = 4, 256 << 20


def write(store: Store, folder: str) -> None:
    """Manifests of all batch directories below ``folder``, staged output of a compaction.

    One pass over three columns, aggregated per file; the driver sees one row per file.
    """
    files = Files(store.spark)
    series, moment = F.struct("car_id", "sensor_id"), micros("event_time")
    bounds = (
        store.spark.read.parquet(folder)
        .groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        .agg(F.min(series).alias("low"), F.max(series).alias("high"), F.min(moment).alias("since"), F.max(moment).alias("until"))
    )
    lines: dict[str, list[str]] = {}
    for row in bounds.toLocalIterator():
        parent, name = row["path"].rsplit("/", 1)
        entry = {"file": name, "bytes": row["bytes"], "low": list(row["low"]), "high": list(row["high"]), "since": row["since"], "until": row["until"]}
        lines.setdefault(parent, []).append(json.dumps(entry))
    side_by_side(lambda item: files.write_text(f"{item[0]}/{NAME}", "\n".join(sorted(item[1]))), lines.items())


def files_of(store: Store, car_id: str, sensor_id: str, start: dt.datetime, end: dt.datetime) -> tuple[list[str], int, bool]:
    """Paths that can hold the series in [start, end), their bytes, and whether all of them are known files."""
    files, paths, size, known = Files(store.spark), [], 0, True
    since, until = ((moment - EPOCH) // dt.timedelta(microseconds=1) for moment in (start, end))
    series = [car_id, sensor_id]
    step = store.chunk
    chunks, chunk = [], EPOCH + (start - EPOCH) // step * step
    while chunk < end:
        chunks.append(chunk)
        chunk += step
    for held in store.directories("raw", chunks):
        folder = f"{store.path('raw')}/{held.name}"
        text = files.read_text(f"{folder}/{NAME}") if held.batch < 0 else None
        if text is None:
            paths.append(folder)
            known = False
            continue
        for entry in map(json.loads, text.splitlines()):
            if entry["low"] <= series <= entry["high"] and entry["since"] < until and entry["until"] >= since:
                paths.append(f"{folder}/{entry['file']}")
                size += entry["bytes"]
    return paths, size, known


def read_series(store: Store, car_id: str, sensor_id: str, start: str | dt.datetime, end: str | dt.datetime) -> DataFrame:
    """Raw readings of one series in [start, end), from the files that can hold them.

    A few known files are read by one task, so that a rollup of them needs no exchange.
    """
    since, until = instant(start), instant(end)
    paths, size, known = files_of(store, car_id, sensor_id, since, until) if since < until else ([], 0, True)
    if not paths:
        return store.spark.createDataFrame([], store.schema("raw"))
    rows = store.read_paths("raw", paths)
    rows = rows.filter(
        (F.col("car_id") == car_id) & (F.col("sensor_id") == sensor_id)
        & (F.col("event_time") >= at(rows, "event_time", since)) & (F.col("event_time") < at(rows, "event_time", until))
    )
    return rows.coalesce(1) if known and len(paths) <= ONE_TASK_FILES and size <= ONE_TASK_BYTES else rows
