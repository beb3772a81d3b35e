"""Streaming ingest: topic to raw table, exactly the stored result of once-delivery."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tachyline.plans.files import Files
from tachyline.plans.ingest import ingest_batch
from tachyline.plans.lifecycle import newest_stored_batch
from tachyline.plans.store import Store
from tachyline.sources.wire import dead_letters, good_readings

RANGE_BITS = 32


def first_batch_id(store: Store, checkpoint: str) -> int:
    """The table's batch id for batch 0 of a checkpoint.

    A batch replaces its own earlier output, so two checkpoints must never use the same
    ids. Each fresh checkpoint gets its own range of 2^32 ids above all others; a
    resumed one keeps its range. The choice is a directory name beside the tables.
    """
    files = Files(store.spark)
    root = f"{store.root}/ingest"
    mine = hashlib.md5(checkpoint.encode()).hexdigest()
    taken = {
        name: [int(first.split("=")[1]) for first in files.children(f"{root}/{name}")]
        for name in files.children(root)
    }
    if taken.get(mine) and files.exists(f"{checkpoint}/metadata"):
        return max(taken[mine])
    newest = max([newest_stored_batch(store), *(first for firsts in taken.values() for first in firsts)])
    first = ((newest >> RANGE_BITS) + 1) << RANGE_BITS
    files.make(f"{root}/{mine}/first={first}")
    return first


def start_ingest(
    decoded: DataFrame, store: Store, checkpoint: str, dead_letter_path: str | None = None, **trigger
) -> StreamingQuery:
    """Write decoded records to the store batch by batch.

    Delivery is at least once: offsets are committed after the write, so a crash in
    between repeats the batch under the same id, and ``ingest_batch`` then replaces
    its own output. Records that could not be decoded go to ``dead_letter_path``, the store's
    own ``dead_letters`` unless given; the metrics count them and the null records.
    """

    first = first_batch_id(store, checkpoint)
    dead_path = dead_letter_path or store.path("dead_letters")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            lost = batch.agg(
                F.count_if(F.col("error").isNotNull()).alias("dead"),
                F.count_if(F.col("error").isNull() & F.col("payload").isNull()).alias("nulls"),
            ).first()
            if lost["dead"]:
                dead_letters(batch).write.mode("overwrite").parquet(f"{dead_path}/batch={first + batch_id}")
            ingest_batch(
                good_readings(batch), first + batch_id, replace(store, spark=batch.sparkSession),
                null_records=lost["nulls"], dead_letters=lost["dead"],
            )
        finally:
            batch.unpersist()

    return (
        decoded.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
