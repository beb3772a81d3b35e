"""Time helpers that keep the column's own timestamp type."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, functions as F

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds_of(duration: str) -> int:
    """Whole seconds of a Spark duration such as ``1 minute`` or ``10 seconds``."""
    parts = re.findall(r"(\d+)\s*([a-z]+)", duration.lower())
    if not parts:
        raise ValueError(f"not a duration: {duration!r}")
    total = 0
    for amount, unit in parts:
        unit = unit.rstrip("s")
        if unit not in _UNIT_SECONDS:
            raise ValueError(f"not a duration: {duration!r}")
        total += int(amount) * _UNIT_SECONDS[unit]
    return total


def iso_duration(duration: str) -> str:
    """ISO-8601 text of a duration: ``1 second`` gives ``PT1S``."""
    hours, rest = divmod(seconds_of(duration), 3600)
    minutes, seconds = divmod(rest, 60)
    text = "".join(f"{n}{unit}" for n, unit in ((hours, "H"), (minutes, "M"), (seconds, "S")) if n)
    return "PT" + (text or "0S")


def interval(duration: str) -> Column:
    return F.expr(f"INTERVAL '{seconds_of(duration)}' SECOND")


def time_bucket(width: str, column: str | Column) -> Column:
    """Start of the epoch-aligned bucket; same type as the input column."""
    return F.window(column, width).start


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def instant(value: str | dt.datetime) -> dt.datetime:
    """A UTC wall-clock datetime from ISO text or a datetime; naive means UTC."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def at(frame: DataFrame, column: str, value: str | dt.datetime) -> Column:
    """A literal of the same timestamp type as ``frame[column]``.

    Comparing like types keeps the predicate free of casts on the column, so it
    reaches the Parquet reader.
    """
    text = instant(value).isoformat(sep=" ")
    if frame.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+00:00").cast("timestamp")


def floor_to(value: dt.datetime, width: str) -> dt.datetime:
    step = dt.timedelta(seconds=seconds_of(width))
    epoch = dt.datetime(1970, 1, 1)
    return epoch + (value - epoch) // step * step


def ceil_to(value: dt.datetime, width: str) -> dt.datetime:
    low = floor_to(value, width)
    return low if low == value else low + dt.timedelta(seconds=seconds_of(width))
