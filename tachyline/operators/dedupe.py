"""Natural-key identity: first arrival wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tachyline.schemas import KEY


def first_arrival(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The earliest arrival of each reading.

    One aggregation with a map-side partial step, so a key with very many copies
    sends one row per task over the network. ``arrival`` must be unique per key.
    """
    rest = [name for name in events.columns if name not in (*KEY, arrival)]
    return (
        events.groupBy(*KEY)
        .agg(*[F.min_by(name, arrival).alias(name) for name in rest], F.min(arrival).alias(arrival))
        .select(*events.columns)
    )


def dedupe_existing(table: DataFrame, row_id: str = "id") -> DataFrame:
    """An unkeyed table reduced to the lowest row id per natural key, id dropped."""
    return first_arrival(table, row_id).drop(row_id)


def reject_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming readings whose key is not stored yet.

    Give ``stored`` already pruned to the partitions that ``incoming`` touches.
    """
    return incoming.join(stored.select(*KEY), KEY, "left_anti")


def _copies(events: DataFrame) -> DataFrame:
    return events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))


def integrity_check(events: DataFrame) -> DataFrame:
    """Rows, distinct readings and surplus copies, from a single shuffle."""
    return _copies(events).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_readings"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
    )


def duplicated_readings(events: DataFrame) -> DataFrame:
    """The natural keys stored more than once."""
    return _copies(events).filter("copies > 1")


def replay_audit(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Published, written and rejected counts without and with the natural key."""
    totals = integrity_check(events).withColumn("published", F.col("rows"))
    layouts = F.array(
        F.struct(
            F.lit("unkeyed").alias("layout"),
            F.col("rows").alias("written"),
            F.lit(0).cast("bigint").alias("rejected"),
            F.col("duplicates").alias("duplicates_stored"),
        ),
        F.struct(
            F.lit("keyed").alias("layout"),
            F.col("distinct_readings").alias("written"),
            F.col("duplicates").alias("rejected"),
            F.lit(0).cast("bigint").alias("duplicates_stored"),
        ),
    )
    return totals.select("published", "distinct_readings", F.inline(layouts))
