"""Sharding by the longest-processing-time rule: equal texts stay together, shard sizes near equal.

The heap takes units in descending order of size, each to the shard that has the least so far.
Units that carry weight are single groups of equal texts: those with at least
1 / (shards * RESOLUTION) of all bytes, of which there can be no more than shards * RESOLUTION.
All smaller groups are dealt by the hash of their text into shards * RESOLUTION bundles, and
each bundle is a unit. The driver therefore sees a bounded number of sizes however many
documents there are, and a shard can exceed another by no more than its last unit.

Null text counts no bytes and shares a group with the empty text. Rows that share a doc_id are
documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tachyline.llm.common import stored

SHARDS = 40
RESOLUTION = 250
ROW_BYTES = 16
ROWS_A_BLOCK = 4_000


def longest_first(sizes: dict, shards: int) -> dict:
    """Unit -> shard; ties go to the unit with the smaller name and the shard with the smaller number."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for unit, size in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        load, shard = heapq.heappop(heap)
        placed[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row per document with its size, shard and place in the shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("_group"),
        ),
        "shard-rows",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    units = shards * RESOLUTION
    blocks = count // (shards * ROWS_A_BLOCK) + 1
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    heavy = groups.filter(F.col("_bytes") * units >= F.lit(total)).select("_group", F.lit(True).alias("_heavy"))
    heavy = F.broadcast(stored(heavy, "shard-heavy"))  # at most `units` rows, by its filter
    bundle = F.pmod(F.xxhash64("_group"), F.lit(units))
    unit = F.when(F.col("_heavy"), F.hex("_group")).otherwise(F.format_string("b%d", bundle))
    united = rows.join(heavy, "_group", "left").withColumn("_unit", unit)
    sizes = {row["_unit"]: row["_bytes"] for row in united.groupBy("_unit").agg(F.sum("size").alias("_bytes")).collect()}
    placed = spark.createDataFrame(list(longest_first(sizes, shards).items()), "_unit string, shard int")
    order = ["doc_id", "text_crc32", "size"]
    dealt = united.join(F.broadcast(placed), "_unit").withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))

    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "_block").count()
        .select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("shard", "_block").orderBy(*order, "_group")
    return (
        dealt.withColumn("_rank", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "_block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_before") + F.col("_rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
