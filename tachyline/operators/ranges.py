"""Range queries over the stored aggregates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tachyline.functions.time import at, instant
from tachyline.schemas import SERIES

ROLLUP_COLUMNS = ["car_id", "sensor_id", "bucket", "samples", "average", "minimum", "maximum"]


#: Ranges up to this are read and sorted by one task: 1440 one-minute rows of one series.
ONE_TASK_RANGE = dt.timedelta(days=1)


class NothingFound(LookupError):
    """A range query matched no rows."""


def default_range(
    now: str | dt.datetime, start: str | dt.datetime | None = None, end: str | dt.datetime | None = None
) -> tuple[dt.datetime, dt.datetime]:
    """(start, end): end defaults to now, start to one hour before end."""
    until = instant(end if end is not None else now)
    since = instant(start) if start is not None else until - dt.timedelta(hours=1)
    return since, until


def in_range(rollups: DataFrame, start: str | dt.datetime, end: str | dt.datetime) -> DataFrame:
    """Buckets in [start, end).

    On a stored table the date partition column is bounded as well: Spark can't derive it from
    the bucket. It prunes reading, not listing; ``Store.rollups_between`` prunes both.
    """
    since, until = instant(start), instant(end)
    kept = rollups.filter(
        (F.col("bucket") >= at(rollups, "bucket", since)) & (F.col("bucket") < at(rollups, "bucket", until))
    )
    if "bucket_date" in rollups.columns:
        kept = kept.filter(F.col("bucket_date").between(F.lit(since.date()), F.lit(until.date())))
    return kept


def find_rollups(
    rollups: DataFrame,
    car_id: str,
    sensor_id: str,
    start: str | dt.datetime,
    end: str | dt.datetime,
    limit: int | None = None,
    on_empty: str = "empty",
) -> DataFrame:
    """One series in [start, end), oldest first, whole unless ``limit`` is given.

    A cut range keeps the oldest rows, and ``truncated`` on each row says that it is cut.
    """
    found = (
        in_range(rollups, start, end)
        .filter((F.col("car_id") == car_id) & (F.col("sensor_id") == sensor_id))
        .select(*ROLLUP_COLUMNS)
    )
    # A series has a row per minute at most: a short range is put in order by one task, without a sampled exchange.
    short = instant(end) - instant(start) <= ONE_TASK_RANGE
    found = found.coalesce(1).sortWithinPartitions("bucket") if short else found.orderBy("bucket")
    if limit is None:
        found = found.withColumn("truncated", F.lit(False))
    else:
        # One row more than asked for tells whether there are more.
        order = Window.partitionBy(*SERIES).orderBy("bucket")
        whole = Window.partitionBy(*SERIES)
        found = (
            found.limit(limit + 1)
            .withColumns({"_rank": F.row_number().over(order), "truncated": F.count(F.lit(1)).over(whole) > limit})
            .filter(F.col("_rank") <= limit)
            .drop("_rank")
            .orderBy("bucket")
        )
    if on_empty == "raise" and found.isEmpty():
        raise NothingFound(f"no rollups for {car_id}/{sensor_id}")
    return found


def is_truncated(
    rollups: DataFrame,
    car_id: str,
    sensor_id: str,
    start: str | dt.datetime,
    end: str | dt.datetime,
    limit: int,
) -> bool:
    """Whether ``find_rollups`` with this limit leaves rows out."""
    return not find_rollups(rollups, car_id, sensor_id, start, end, limit).filter("truncated").isEmpty()


def find_channels(
    rollups: DataFrame,
    car_id: str,
    sensor_ids: Sequence[str],
    start: str | dt.datetime,
    end: str | dt.datetime,
    limit: int | None = None,
) -> DataFrame:
    """Channels of one car in a single scan; with a ``limit``, each one's oldest rows.

    ``truncated`` says for each row whether its channel is cut.
    """
    found = (
        in_range(rollups, start, end)
        .filter((F.col("car_id") == car_id) & F.col("sensor_id").isin(list(sensor_ids)))
        .select(*ROLLUP_COLUMNS)
    )
    if limit is None:
        return found.withColumn("truncated", F.lit(False))
    oldest = F.row_number().over(Window.partitionBy(*SERIES).orderBy("bucket"))
    kept = found.withColumn("_rank", oldest).filter(F.col("_rank") <= limit + 1)
    more = F.max("_rank").over(Window.partitionBy(*SERIES)) > limit
    return kept.withColumn("truncated", more).filter(F.col("_rank") <= limit).drop("_rank")


def cars(rollups: DataFrame) -> DataFrame:
    """Car ids present in the aggregates, sorted."""
    return rollups.select("car_id").distinct().orderBy("car_id")


def sensors(rollups: DataFrame) -> DataFrame:
    """Sensor ids present in the aggregates, sorted."""
    return rollups.select("sensor_id").distinct().orderBy("sensor_id")


def channel_order(sensor_ids: DataFrame) -> DataFrame:
    """Named channels first, padding channels last, alphabetical within each."""
    return sensor_ids.orderBy(F.col("sensor_id").startswith("aux-channel-"), "sensor_id")


def search_channels(sensor_ids: DataFrame, term: str) -> DataFrame:
    """Channels whose id contains the trimmed term, ignoring case."""
    return sensor_ids.filter(F.lower("sensor_id").contains(term.strip().lower()))
