"""Small tables that a stream keeps up to date: statistics, alert history, the live board.

Such a view is a directory of versions. Every micro-batch folds its rows into the version before and writes the
next; readers take the newest complete one. A version's name says which query and which of its batches made it: a
repeated batch starts from the same version again, and a query whose checkpoint was lost starts from
nothing, as its own state does, so replays are never counted twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tachyline.operators import board
from tachyline.operators.alerts import recent_alerts
from tachyline.plans.files import Files
from tachyline.streaming.live import run_single


@dataclass(frozen=True)
class View:
    """Versions below ``path``, made by the query of ``checkpoint``."""

    path: str
    checkpoint: str

    def fold(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> None:
        """Write ``merge(batch, version before)`` as the next version and drop what isn't needed any more."""
        spark = batch.sparkSession
        files, found, run = Files(spark), versions(spark, self.path), self._query(spark)
        mine = [name for _, made_by, made_in, name in found if made_by == run and made_in < batch_id]
        before = spark.read.parquet(f"{self.path}/{mine[-1]}") if mine else None
        number = found[-1][0] + 1 if found else 0
        merge(batch, before).write.mode("overwrite").parquet(f"{self.path}/version={number:012d}_{run}_{batch_id}")
        for *_, name in found:
            if name not in mine[-1:]:
                files.delete(f"{self.path}/{name}")

    def _query(self, spark: SparkSession) -> str:
        """The id Spark gave the query when it made this checkpoint."""
        text = "".join(row[0] for row in spark.read.text(f"{self.checkpoint}/metadata").collect())
        return json.loads(text)["id"].replace("-", "")

    def start(self, rows: DataFrame, merge, mode: str = "append", **trigger) -> StreamingQuery:
        writer = (
            rows.writeStream.outputMode(mode)
            .option("checkpointLocation", self.checkpoint)
            .foreachBatch(lambda batch, batch_id: self.fold(batch, batch_id, merge))
        )
        return run_single(writer, rows.sparkSession, **trigger)


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, int, str]]:
    """The complete versions, ascending: number, query, batch, name."""
    files, found = Files(spark), []
    for name in files.children(path):
        if name.startswith("version=") and files.exists(f"{path}/{name}/_SUCCESS"):
            number, run, batch = name.split("=")[1].split("_")
            found.append((int(number), run, int(batch), name))
    return sorted(found)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{path}/{versions(spark, path)[-1][-1]}")


def start_alert_history(
    alerts: DataFrame, size: int, path: str, checkpoint: str, arrival: str = "arrived_at", **trigger
) -> StreamingQuery:
    """Keep the ``size`` alerts that arrived last; ``recent_alerts`` reads any number up to that."""

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        rows = batch if before is None else batch.unionByName(before)
        return recent_alerts(rows, size, arrival)

    return View(path, checkpoint).start(alerts, merge, **trigger)


def start_live_board(rollups: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep one row of partial states per car, from one-second rollups as they arrive."""

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        fresh = board.board_states(batch)
        return fresh if before is None else board.merged_board(fresh.unionByName(before))

    return View(path, checkpoint).start(rollups, merge, **trigger)


def start_breaches(
    alerts: DataFrame, path: str, checkpoint: str, arrival: str = "window_end", **trigger
) -> StreamingQuery:
    """Keep each car's last alert."""

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        last = board.last_alert(batch, arrival)
        return last if before is None else board.last_alert(last.unionByName(before), arrival)

    return View(path, checkpoint).start(alerts, merge, **trigger)


def current_board(spark: SparkSession, board_path: str, breach_path: str, now, arrival: str = "window_end") -> DataFrame:
    """The live board at ``now`` from the two views: a read of one row per car each."""
    return board.finished_board(current(spark, board_path), current(spark, breach_path), now, arrival)
