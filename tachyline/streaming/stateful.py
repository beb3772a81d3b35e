"""Streams with state of their own: the exact late rule, and what is over when nothing more comes.

Spark's watermark moves per micro-batch and over all partitions. Here stream time is kept per source
partition and moves with every record, in the order of the topic: a reading is late if its window's end is at
or before the highest event time seen so far in its partition, itself included, less the grace period. The
order inside a micro-batch is the topic's, however the batch was read, so a stream gives the same rollups
and the same count of late readings as ``late_audit`` over the whole topic, batched in any way.

A source partition is one state: its records have an order, so one task handles them, as one
consumer does. Their number per micro-batch is bounded by the source (``per_trigger``). The state is the stream time and the
windows that are still open, a few per series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tachyline.functions.time import iso_duration, micros, seconds_of
from tachyline.operators.rollups import LIVE_COLUMNS
from tachyline.schemas import SERIES
from tachyline.sources.topics import Topic
from tachyline.sources.wire import rollups_to_json
from tachyline.streaming.live import run_single

LATE_COLUMNS = ["stream_partition", "readings", "late_readings", "worst_lateness_us", "stream_time"]
_LOG = (
    "kind string, car_id string, sensor_id string, window_start bigint, window_end bigint, count bigint, "
    "average double, minimum double, maximum double, "
    "stream_partition string, readings bigint, late_readings bigint, worst_lateness_us bigint, stream_time bigint"
)
_STATE = [*SERIES, "start", "count", "total", "minimum", "maximum"]
#: Closed windows that leave Python at once.
WINDOWS_AT_ONCE = 20_000


class _Series:
    """Numbers for the series of a source partition: a reading then costs a few fixed-width numbers, not its strings."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}

    def of(self, rows: pd.DataFrame) -> np.ndarray:
        local = rows.groupby(SERIES, sort=False, dropna=False).ngroup().to_numpy()
        firsts = rows.loc[~rows.duplicated(SERIES), SERIES].itertuples(index=False, name=None)
        numbers = [self.numbers.setdefault(pair, len(self.numbers)) for pair in firsts]
        return np.array(numbers, np.int32)[local]

    def names(self, numbers: np.ndarray) -> dict[str, np.ndarray]:
        columns = zip(*self.numbers) if self.numbers else ([],) * len(SERIES)
        return {name: np.array(column, object)[numbers] for name, column in zip(SERIES, columns)}

    def ranks(self) -> np.ndarray:
        order = sorted(self.numbers, key=lambda pair: [(name is not None, name or "") for name in pair])
        ranks = np.empty(len(order), np.int64)
        ranks[[self.numbers[pair] for pair in order]] = np.arange(len(order))
        return ranks


def _combined(parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One entry per series and window; a NaN makes sum and maximum NaN, as it orders above all numbers."""
    order = np.lexsort((parts["series"], parts["start"]))  # stable: sums add up in the order of the topic
    series, start = parts["series"][order], parts["start"][order]
    first = np.ones(len(order), bool)
    first[1:] = (series[1:] != series[:-1]) | (start[1:] != start[:-1])
    at = np.flatnonzero(first)
    out = {"series": series[at], "start": start[at]}
    with np.errstate(invalid="ignore"):
        for name, add in (("count", np.add), ("total", np.add), ("minimum", np.fmin), ("maximum", np.maximum)):
            out[name] = add.reduceat(parts[name][order], at) if len(at) else parts[name]
    return out


class ExactWindows(StatefulProcessor):
    """Windows of one source partition; times are microseconds."""

    def __init__(self, window_us: int, grace_us: int):
        self.window, self.grace = window_us, grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "stream_time bigint, windows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, columns = _Series(), {"arrival": [], "time": [], "value": [], "series": []}
        for some in rows:
            for column in ("arrival", "time", "value"):
                columns[column].append(some[column].to_numpy())
            columns["series"].append(names.of(some))
        order = np.argsort(np.concatenate(columns.pop("arrival")), kind="stable")
        times, values, series = (np.concatenate(columns.pop(column))[order] for column in ("time", "value", "series"))
        del order
        stream_time, open_ = None, None
        if self.state.exists():
            stream_time, windows = self.state.get()
            open_ = pa.ipc.open_stream(windows).read_pandas()
        seen = np.maximum.accumulate(times if stream_time is None else np.maximum(times, stream_time))
        start = times - times % self.window
        late = start + self.window <= seen - self.grace
        n_times, n_late, worst, now = len(times), int(late.sum()), int((seen - times).max()), int(seen[-1])
        del times, seen
        start, values, series = start[~late], values[~late].astype(np.float64), series[~late]
        del late
        parts = {
            "series": series, "start": start, "count": np.ones(len(start), np.int64),
            "total": values, "minimum": values, "maximum": values,
        }
        if open_ is not None and len(open_):
            held = {name: open_[name].to_numpy() for name in _STATE[len(SERIES) :]} | {"series": names.of(open_)}
            parts = {name: np.concatenate([held[name], parts[name]]) for name in parts}
        parts = _combined(parts)
        closed = parts["start"] + self.window + self.grace <= now
        left = {name: column[~closed] for name, column in parts.items()}
        left = pa.Table.from_pandas(pd.DataFrame(names.names(left.pop("series")) | left)[_STATE], preserve_index=False)
        buffer = pa.BufferOutputStream()
        with pa.ipc.new_stream(buffer, left.schema) as writer:
            writer.write_table(left)
        self.state.update((now, buffer.getvalue().to_pybytes()))
        done = {name: column[closed] for name, column in parts.items()}
        del parts
        order = np.lexsort((names.ranks()[done["series"]], done["start"]))
        for at in range(0, len(order), WINDOWS_AT_ONCE):
            some = {name: column[order[at : at + WINDOWS_AT_ONCE]] for name, column in done.items()}
            yield pd.DataFrame(
                {
                    "kind": "rollup", **names.names(some["series"]),
                    "window_start": some["start"], "window_end": some["start"] + self.window, "count": some["count"],
                    "average": some["total"] / some["count"], "minimum": some["minimum"], "maximum": some["maximum"],
                    "stream_partition": key[0], "readings": 0, "late_readings": 0, "worst_lateness_us": 0, "stream_time": 0,
                }
            )
        yield pd.DataFrame(
            {
                "kind": ["late"], "car_id": [None], "sensor_id": [None], "window_start": [0], "window_end": [0],
                "count": [0], "average": [0.0], "minimum": [0.0], "maximum": [0.0], "stream_partition": [key[0]],
                "readings": [n_times], "late_readings": [n_late], "worst_lateness_us": [worst], "stream_time": [now],
            }
        )

    def close(self) -> None:
        pass


def exact_windows(
    readings: DataFrame, window: str, grace: str, partition: str = "topic_partition", arrival: str = "arrival"
) -> DataFrame:
    """Final rollups and one report per source partition and micro-batch, told apart by ``kind``.

    ``arrival`` orders the records of a partition. Readings without a time are left out.
    """
    rows = readings.filter(F.col("event_time").isNotNull()).select(
        F.col(partition).cast("string").alias("_partition"), *SERIES, micros("event_time").alias("time"), "value",
        F.col(arrival).alias("arrival"),
    )
    log = rows.groupBy("_partition").transformWithStateInPandas(
        ExactWindows(int(seconds_of(window) * 1_000_000), int(seconds_of(grace) * 1_000_000)),
        _LOG, outputMode="Append", timeMode="None",
    )
    instants = {name: F.timestamp_micros(name) for name in ("window_start", "window_end", "stream_time")}
    # pandas hands a NaN over as null; no window is without a value
    numbers = {name: F.coalesce(name, F.lit(float("nan"))) for name in ("average", "minimum", "maximum")}
    return log.withColumns(instants).withColumns(numbers).withColumn("window_length", F.lit(iso_duration(window)))


def start_exact_rollups(
    readings: DataFrame, window: str, grace: str, log: str, checkpoint: str, partition: str = "topic_partition",
    arrival: str = "arrival", **trigger,
) -> StreamingQuery:
    """Write rollups and late reports to the directory ``log``, each exactly once."""
    rows = exact_windows(readings, window, grace, partition, arrival)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet")
    return run_single(writer.option("path", log), readings.sparkSession, **trigger)


_READ = _LOG.replace("window_start bigint, window_end bigint", "window_start timestamp, window_end timestamp")
_READ = _READ.replace("stream_time bigint", "stream_time timestamp") + ", window_length string"


def exact_rollups(spark: SparkSession, log: str, stream: bool = False) -> DataFrame:
    """The rollups of a log, as a table or a stream."""
    reader = (spark.readStream if stream else spark.read).schema(_READ)
    return reader.parquet(log).filter("kind = 'rollup'").select(*LIVE_COLUMNS)


def late_reports(spark: SparkSession, log: str) -> DataFrame:
    """Per source partition: readings, late ones among them, the worst lateness, and stream time now.

    The counts are the state's own, over the whole life of the stream.
    """
    rows = spark.read.schema(_READ).parquet(log).filter("kind = 'late'")
    return rows.groupBy("stream_partition").agg(
        F.sum("readings").alias("readings"), F.sum("late_readings").alias("late_readings"),
        (F.max("worst_lateness_us") / 1e6).alias("worst_lateness_s"), F.max("stream_time").alias("stream_time"),
    )


def start_publish(spark: SparkSession, log: str, topic: Topic, checkpoint: str, **trigger) -> StreamingQuery:
    """Publish the rollups of a log to a topic: stateless."""
    records = rollups_to_json(exact_rollups(spark, log, stream=True))
    return run_single(topic.sink(records, checkpoint), spark, **trigger)


# --- held for a while ----------------------------------------------------------------------


_HELD = "at bigint, active boolean, sensor_id string, observed_maximum double, threshold double"
_ORDER = ["at", "window_start", "sensor_id", "threshold"]


class Held(StatefulProcessor):
    """What an event starts and its absence for ``hold`` ends, per car.

    ``every`` event is reported (a breach shows the newest alert), or only the turns from off to on (a signal).
    The end comes from a timer once the watermark has passed it, or from the next event if that comes first.
    """

    def __init__(self, hold_us: int, every: bool):
        self.hold, self.every = hold_us, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "last", "at bigint, window_start bigint, sensor_id string, observed_maximum double, threshold double, active boolean"
        )

    def _ends(self, at: int) -> int:
        return -(-(at + self.hold) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(_ORDER).drop_duplicates("at", keep="last")
        last = self.state.get() if self.state.exists() else None
        before, out = last, []
        for at, start, sensor, observed, threshold in data[[*_ORDER[:3], "observed_maximum", "threshold"]].itertuples(index=False):
            row = (int(at), int(start), sensor, float(observed), float(threshold), True)
            if last is not None and (row[0], row[1], row[2], row[4]) <= (last[0], last[1], last[2], last[4]):
                continue
            if last is not None and last[5] and row[0] > last[0] + self.hold:
                out.append((key[0], last[0] + self.hold, False, None, None, None))
                last = (*last[:5], False)
            if self.every or last is None or not last[5]:
                out.append((key[0], row[0], True, sensor, row[3], row[4]))
            last = row
        if last is not before:
            if before is not None and before[5]:
                self.handle.deleteTimer(self._ends(before[0]))
            self.handle.registerTimer(self._ends(last[0]))
            self.state.update(tuple(last))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.state.get()
        if last[5] and self._ends(last[0]) == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((*last[:5], False))
            yield self._frame([(key[0], last[0] + self.hold, False, None, None, None)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = ["car_id", "at", "active", "sensor_id", "observed_maximum", "threshold"]
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"at": "int64", "active": "bool", "observed_maximum": "float64", "threshold": "float64"})

    def close(self) -> None:
        pass


def _held(events: DataFrame, hold: str, patience: str, every: bool) -> DataFrame:
    timed = events.withWatermark("window_end", patience).select(
        "car_id", "window_end", micros("window_end").alias("at"), micros("window_start").alias("window_start"),
        "sensor_id", "observed_maximum", "threshold",
    )
    changes = timed.groupBy("car_id").transformWithStateInPandas(
        Held(int(seconds_of(hold) * 1_000_000), every), "car_id string, " + _HELD, outputMode="Append", timeMode="EventTime"
    )
    return changes.withColumn("at", F.timestamp_micros("at"))


def signal_changes(
    rollups: DataFrame, sensor_id: str, patience: str, stale_after: str = "6 seconds"
) -> DataFrame:
    """A row whenever a car's signal comes or is lost: on at the window that brings it, off ``stale_after`` its last.

    ``patience``: how far behind the newest window another car's may come in.
    """
    seen = rollups.filter(F.col("sensor_id") == sensor_id)
    none = F.lit(0.0)
    changes = _held(seen.withColumn("observed_maximum", none).withColumn("threshold", none), stale_after, patience, False)
    return changes.select("car_id", "at", F.col("active").alias("has_signal"))


def breach_changes(alerts: DataFrame, patience: str, hold: str = "30 seconds") -> DataFrame:
    """A row whenever a car's active breach is another one or is over."""
    return _held(alerts, hold, patience, True)


def start_changes(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the changes to a directory, each exactly once."""
    writer = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet")
    return run_single(writer.option("path", path), changes.sparkSession, **trigger)
