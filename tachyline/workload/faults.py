"""Dropouts, replays and anomalies as transforms of a readings table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tachyline.functions.time import at
from tachyline.plans.blocked import BLOCK_ROWS, kth_value
from tachyline.plans.sizing import broadcast_if_small

BUFFER_CAPACITY = 500_000
OVERLAP_SIZE = 2_000


def last_delivered(
    events: DataFrame, cut: int, n: int, arrival: str = "arrival", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``n`` most recent readings that arrived before ``cut``."""
    before = events.filter(F.col(arrival) < cut)
    if n <= 0:
        return before.limit(0)
    edge = kth_value(before, arrival, n, largest=True, block_rows=block_rows)
    return before if edge is None else before.filter(F.col(arrival) >= edge)


def concatenate(*parts: DataFrame) -> DataFrame:
    """Frames one after the other, duplicates kept."""
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined


@dataclass(frozen=True)
class Dropout:
    """Arrival numbers that fix what a dropout does to a readings table."""

    first_held: int
    last_held: int
    last_kept: int
    first_rest: int | None
    cut: int
    oldest_copy: int | None

    @property
    def copies_up(self) -> int:
        return 0 if self.oldest_copy is None else self.cut - self.oldest_copy + 1

    @property
    def held_up(self) -> int:
        return self.cut + self.copies_up - self.first_held + 1

    @property
    def rest_up(self) -> int:
        return self.last_held + self.held_up - max(self.cut, self.last_held)


def plan_dropout(
    events: DataFrame,
    start: str | dt.datetime,
    end: str | dt.datetime,
    overlap: int = OVERLAP_SIZE,
    capacity: int = BUFFER_CAPACITY,
    replay_at: str | dt.datetime | None = None,
    arrival: str = "arrival",
    block_rows: int = BLOCK_ROWS,
) -> Dropout | None:
    """Look up the order statistics of a dropout during [start, end); None if it holds nothing.

    Everything that arrives between the first and last reading of that time is held.
    Each lookup is one aggregation over the arrival number and event time alone.
    """
    order = F.col(arrival)
    rows = events.select(arrival, "event_time")
    inside = (F.col("event_time") >= at(events, "event_time", start)) & (
        F.col("event_time") < at(events, "event_time", end)
    )
    first_held, last_held = rows.filter(inside).agg(F.min(arrival), F.max(arrival)).first()
    if first_held is None:
        return None
    resumes = at(events, "event_time", end if replay_at is None else replay_at)
    held = order.between(first_held, last_held)
    held_count, first_rest = rows.filter(order >= first_held).agg(
        F.count_if(held), F.min(F.when((order > last_held) & (F.col("event_time") >= resumes), order))
    ).first()
    direct = ~held if first_rest is None else ~held & (order < first_rest)
    newest, oldest = rows.filter(direct).agg(F.max(arrival), F.min(arrival)).first()
    oldest_copy = None
    if overlap > 0 and newest is not None:
        oldest_copy = kth_value(rows.filter(direct), arrival, overlap, True, block_rows)
        oldest_copy = oldest if oldest_copy is None else oldest_copy
    last_kept = last_held
    if capacity <= 0:
        last_kept = first_held - 1
    elif capacity < held_count:
        last_kept = kth_value(rows.filter(held), arrival, capacity, block_rows=block_rows)
    return Dropout(
        first_held, last_held, last_kept, first_rest, first_held - 1 if newest is None else newest, oldest_copy
    )


def apply_dropout(events: DataFrame, plan: Dropout | None, arrival: str = "arrival") -> DataFrame:
    """The deliveries of a planned dropout: one scan, no sort, no shuffle.

    ``arrival`` is renumbered to the order of delivery and ``replayed`` marks the rows
    that the replay sent. ``events`` may carry more columns than the plan was made from.
    """
    if plan is None:
        return events.withColumn("replayed", F.lit(False))
    order = F.col(arrival)
    held = order.between(plan.first_held, plan.last_held)
    rest = F.lit(False) if plan.first_rest is None else order >= plan.first_rest
    copied = F.lit(False) if plan.oldest_copy is None else ~held & ~rest & (order >= plan.oldest_copy)

    def sent(up: int, replayed: bool) -> Column:
        number = (order + F.lit(up)).cast("bigint")
        return F.struct(number.alias(arrival), F.lit(replayed).alias("replayed"))

    # Each reading expands into its deliveries in place.
    deliveries = (
        F.when(copied, F.array(sent(0, False), sent(plan.copies_up, True)))
        .when(held, F.array(sent(plan.held_up, True)))
        .when(rest, F.array(sent(plan.rest_up, False)))
        .otherwise(F.array(sent(0, False)))
    )
    others = [name for name in events.columns if name != arrival]
    return (
        events.filter(~(held & (order > plan.last_kept)))
        .select(*others, F.inline(deliveries))
        .select(*events.columns, "replayed")
    )


def dropout_replay(
    events: DataFrame,
    start: str | dt.datetime,
    end: str | dt.datetime,
    overlap: int = OVERLAP_SIZE,
    capacity: int = BUFFER_CAPACITY,
    replay_at: str | dt.datetime | None = None,
    arrival: str = "arrival",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Readings as they arrive when the uplink drops out during [start, end).

    Readings in the dropout are held back; the first ``capacity`` of them are kept
    and the rest lost. Live traffic resumes at ``end``. At ``replay_at`` (by default
    ``end``) the last ``overlap`` readings delivered until then come once more, then
    the held ones in order. ``arrival`` is a unique integer.
    """
    plan = plan_dropout(events, start, end, overlap, capacity, replay_at, arrival, block_rows)
    return apply_dropout(events, plan, arrival)


def dropped_by_buffer(
    events: DataFrame,
    start: str | dt.datetime,
    end: str | dt.datetime,
    capacity: int = BUFFER_CAPACITY,
    arrival: str = "arrival",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The readings of a dropout that a full buffer loses."""
    plan = plan_dropout(events, start, end, 0, capacity, None, arrival, block_rows)
    if plan is None:
        return events.limit(0)
    order = F.col(arrival)
    return events.filter((order > plan.last_kept) & (order <= plan.last_held))


def inject_anomaly(events: DataFrame, catalogue: DataFrame, car_id: str, sensor_id: str) -> DataFrame:
    """One series pinned a quarter of its range above the range's top."""
    limits = broadcast_if_small(catalogue.select("sensor_id", "minimum_value", "maximum_value"))
    span = F.col("maximum_value") - F.col("minimum_value")
    flagged = (
        (F.col("car_id") == car_id) & (F.col("sensor_id") == sensor_id) & F.col("maximum_value").isNotNull()
    )
    return (
        events.join(limits, "sensor_id", "left")
        .withColumn(
            "value",
            F.when(flagged, F.col("maximum_value") + F.lit(0.25) * span).otherwise(F.col("value")),
        )
        .select(*events.columns)
    )
