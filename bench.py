"""Benchmark: headline queries on the driver's tables, and the 12-million-row series.

Prints one JSON line. ``queries`` holds seconds (median of three warm runs, one run for
jobs that write), planning included. BENCH_SF_DIR, BENCH_CPUS and BENCH_TICKS (96,000 gives 12 million
readings) set the scale. Session start and building the series are not timed as queries;
their seconds are under ``setup``. Queries over alerts, the live board and lanes read tables of
rollups that the warm-up run builds, and the replay queries use a dropout plan looked
up in it: their seconds are those of the query alone, and ``first_runs`` has those of the warm-up
run, input and all. Ingest is timed into an empty table and into an hour that is filled already.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import datetime as dt  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from tachyline.operators import dedupe, ranges, rollups  # noqa: E402
from tachyline.plans import ingest, lifecycle, manifest  # noqa: E402
from tachyline.plans.files import scratch_path  # noqa: E402
from tachyline.plans.store import Store, salt  # noqa: E402
from tachyline.session import build_session  # noqa: E402
from tachyline.sources.readings import event_readings, seed_series  # noqa: E402
from tachyline.workload.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
TICKS = int(os.environ.get("BENCH_TICKS", "96000"))
HEADLINE = [
    "rollup_1m", "rollup_1h", "live_rollups", "threshold_alerts", "session_stats", "latest_reading",
    "live_board", "lane_scale", "integrity_check", "first_arrival", "replay_audit", "dropout_replay",
    "late_summary", "sequence_gaps", "systematic_sample", "counter_rate", "skew_report",
    "protobuf_round_trip", "json_round_trip", "wire_size_audit",
]


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(job, runs: int = 3) -> float:
    seconds = []
    for _ in range(runs):
        started = time.perf_counter()
        job()
        seconds.append(time.perf_counter() - started)
    return round(statistics.median(seconds), 4)


def series(spark, times: dict[str, float], setup: dict[str, float], facts: dict[str, float]) -> None:
    """The published comparison: raw rollup, aggregate read and slice over one series set."""
    store = Store(spark, scratch_path(spark, "bench"), zoned=False).create()
    started = time.perf_counter()
    rows = seed_series(spark, ticks=TICKS).withColumn("arrival", F.monotonically_increasing_id())
    chunked = store.with_event_chunk(rows).withColumn("batch_id", F.lit(0).cast("bigint"))
    store.write(chunked, "raw", salt(CPUS, "car_id", "sensor_id"))
    setup["series_write"] = round(time.perf_counter() - started, 3)
    started = time.perf_counter()
    lifecycle.backfill(store)
    setup["series_backfill"] = round(time.perf_counter() - started, 3)

    started = time.perf_counter()
    lifecycle.compact(store, dt.datetime(2024, 1, 1, 4))
    setup["series_compact"] = round(time.perf_counter() - started, 3)

    raw = store.read("raw")
    start = dt.datetime(2024, 1, 1, 0, 10)
    end = start.replace(minute=20)

    def ten_minutes():
        return rollups.rollup_1m(manifest.read_series(store, "CAR-03", "speed", start, end))

    jobs = {
        "floor_empty_job": lambda: spark.range(1).collect(),
        "series_raw_rollup_1m": lambda: drain(rollups.rollup_1m(raw)),
        "series_read_rollup_1m": lambda: store.rollups().toArrow(),
        "series_read_rollup_1h": lambda: store.rollups("ONE_HOUR").toArrow(),
        "series_slice_10min_raw": lambda: ten_minutes().collect(),
        "series_find_rollups": lambda: ranges.find_rollups(
            store.rollups_between("ONE_MINUTE", start, end), "CAR-03", "speed", start, end
        ).collect(),
    }
    for name, job in jobs.items():
        job()
        times[name] = timed(job)
    report = lifecycle.storage_report(
        store, {name: store.path(name) for name in ("raw", "rollup_1m", "rollup_1h")}
    )
    for row in report.collect():
        facts[f"{row['layout']}_rows"], facts[f"{row['layout']}_bytes"] = row["rows"], row["bytes"]

    # Idempotent ingest: a tenth of the series, then the same again (all rejected).
    part = raw.filter(F.col("sequence_no") < TICKS // 10)
    target = Store(spark, scratch_path(spark, "bench-ingest"), zoned=False).create()
    counted: list[tuple[int, int]] = []
    times["ingest_batch"] = timed(lambda: counted.append(ingest.ingest_batch(part, 0, target)), 1)
    times["ingest_replay"] = timed(lambda: counted.append(ingest.ingest_batch(part, 1, target)), 1)
    # A second's worth of readings into the running hour, filled but for its last minute.
    until = start.replace(hour=0, minute=0) + dt.timedelta(minutes=30)
    hour = store.read_chunks("raw", [start.replace(minute=0)])
    moment = F.lit(until.isoformat(sep=" ")).cast("timestamp_ntz")
    filled = Store(spark, scratch_path(spark, "bench-filled"), zoned=False).create()
    ingest.ingest_batch(hour.filter(F.col("event_time") < moment), 0, filled)
    last = hour.filter((F.col("event_time") >= moment) & (F.col("event_time") < moment + F.expr("INTERVAL '1' SECOND")))
    times["ingest_filled_hour"] = timed(lambda: counted.append(ingest.ingest_batch(last, 1, filled)), 1)
    facts["ingest_events_per_s"] = round(counted[0][1] / times["ingest_batch"])
    facts["replay_written"] = counted[1][1]


def main() -> None:
    started = time.perf_counter()
    spark = build_session(
        f"local[{CPUS}]", "tachyline-bench", shuffle_partitions=CPUS, **{"spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    setup = {"session": round(time.perf_counter() - started, 3)}
    times: dict[str, float] = {}
    facts: dict[str, float] = {}
    drain(dedupe.integrity_check(event_readings(spark, SF_DIR)))
    first_runs: dict[str, float] = {}
    for name in HEADLINE:
        job = QUERIES[name]
        first_runs[name] = timed(lambda job=job: drain(job(spark, SF_DIR)), 1)
        times[name] = timed(lambda job=job: drain(job(spark, SF_DIR)))
    series(spark, times, setup, facts)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "series_rows": TICKS * 125,
                "setup": setup,
                "first_runs": first_runs,
                "facts": facts,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
