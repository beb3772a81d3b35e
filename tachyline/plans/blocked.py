"""Running computations over long ordered groups, without one task per group.

A window function sorts each whole group in one task. That fails when one
partition or series holds a large share of all rows. Here each group is cut into
blocks along its order; a block is summarised with an ordinary (map-side combined)
aggregation, the few block summaries are scanned per group, and the result enters
each block as a carry. The row-level window then sees one block at a time. Results
are exact for any block size.

``order`` must be unique within a group. Group columns must not be null (they are
``not null`` in the data model).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 1_000_000
_BLOCK = "_block"


def by_position(order: str, rows: int = BLOCK_ROWS) -> Column:
    """Block (its first number) of a unique integer: at most ``rows`` rows per block."""
    return F.col(order) - F.pmod(F.col(order), F.lit(rows))


def by_time(order: str, width: str = "1 hour") -> Column:
    """Block from event time; its size is bounded by the sampling rate times ``width``."""
    return F.window(order, width).start


def _blocks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(_BLOCK)


def _inside(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, _BLOCK).orderBy(order)


def _with_carry(tagged: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tagged.join(carry, [*keys, _BLOCK], "left")


def running_max(
    rows: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: Column
) -> DataFrame:
    """Add ``out``: the maximum of ``value`` up to and including each row."""
    tagged = rows.withColumn(_BLOCK, block)
    earlier = _blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        tagged.groupBy(*keys, _BLOCK)
        .agg(F.max(value).alias("_top"))
        .select(*keys, _BLOCK, F.max("_top").over(earlier).alias("_carry"))
    )
    so_far = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_carry(tagged, carry, keys)
        .withColumn(out, F.greatest(F.max(value).over(so_far), F.col("_carry")))
        .drop(_BLOCK, "_carry")
    )


def position(rows: DataFrame, keys: Sequence[str], order: str, out: str, block: Column) -> DataFrame:
    """Add ``out``: the 1-based position of each row within its group."""
    tagged = rows.withColumn(_BLOCK, block)
    earlier = _blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        tagged.groupBy(*keys, _BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, _BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
    )
    return (
        _with_carry(tagged, carry, keys)
        .withColumn(out, F.row_number().over(_inside(keys, order)) + F.col("_carry"))
        .drop(_BLOCK, "_carry")
    )


def running_sum(
    rows: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: Column
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including each row."""
    tagged = rows.withColumn(_BLOCK, block)
    earlier = _blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        tagged.groupBy(*keys, _BLOCK)
        .agg(F.sum(value).alias("_n"))
        .select(*keys, _BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
    )
    so_far = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_carry(tagged, carry, keys)
        .withColumn(out, F.sum(value).over(so_far) + F.col("_carry"))
        .drop(_BLOCK, "_carry")
    )


def previous(
    rows: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], block: Column
) -> DataFrame:
    """Add, for each ``source -> out`` pair, the value held by the preceding row."""
    tagged = rows.withColumn(_BLOCK, block)
    lasts = tagged.groupBy(*keys, _BLOCK).agg(
        *[F.max_by(source, order).alias(f"_last_{out}") for source, out in columns.items()]
    )
    carry = lasts.select(
        *keys,
        _BLOCK,
        *[F.lag(f"_last_{out}").over(_blocks(keys)).alias(f"_carry_{out}") for out in columns.values()],
    )
    inside = _inside(keys, order)
    joined = _with_carry(tagged, carry, keys).withColumn("_rank", F.row_number().over(inside))
    for source, out in columns.items():
        joined = joined.withColumn(
            out,
            F.when(F.col("_rank") == 1, F.col(f"_carry_{out}")).otherwise(F.lag(source).over(inside)),
        )
    return joined.drop(_BLOCK, "_rank", *[f"_carry_{out}" for out in columns.values()])


def trailing_sum(
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    out: str,
    range_seconds: int,
    block_seconds: int = 3600,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over (t - range, t] for each row.

    Rows near the end of a block are copied into the following block, where they
    serve as history only.
    """
    span = max(block_seconds, range_seconds)
    step = F.expr(f"INTERVAL '{span}' SECOND")
    reach = F.expr(f"INTERVAL '{range_seconds}' SECOND")
    own = F.window(time, f"{span} seconds").start
    tagged = rows.withColumn("_own", own)
    homes = F.when(
        F.col(time) > F.col("_own") + step - reach,
        F.array(F.col("_own"), F.col("_own") + step),
    ).otherwise(F.array(F.col("_own")))
    frame = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy(F.unix_micros(F.col(time).cast("timestamp")))
        .rangeBetween(-(range_seconds * 1_000_000 - 1), 0)
    )
    return (
        tagged.withColumn(_BLOCK, F.explode(homes))
        .withColumn(out, F.sum(value).over(frame))
        .filter(F.col(_BLOCK) == F.col("_own"))
        .drop("_own", _BLOCK)
    )


def kth_value(
    rows: DataFrame, order: str, k: int, largest: bool = False, block_rows: int = BLOCK_ROWS
) -> int | None:
    """The k-th smallest (or largest) value of a unique integer column, or None.

    A histogram over blocks finds the block that holds it; only that block, of at
    most ``block_rows`` rows, is then sorted. None means fewer than ``k`` rows.
    """
    if k <= 0:
        return None
    blocks = rows.groupBy(by_position(order, block_rows).alias(_BLOCK)).agg(F.count(F.lit(1)).alias("_n"))
    direction = F.col(_BLOCK).desc() if largest else F.col(_BLOCK).asc()
    upto = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        blocks.withColumn("_upto", F.sum("_n").over(upto))
        .filter((F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k))
        .first()
    )
    if hit is None:
        return None
    rest = k - (hit["_upto"] - hit["_n"])
    inside = rows.filter(by_position(order, block_rows) == hit[_BLOCK]).select(order)
    if largest:
        return inside.orderBy(F.col(order).desc()).limit(rest).agg(F.min(order)).first()[0]
    return inside.orderBy(order).limit(rest).agg(F.max(order)).first()[0]
