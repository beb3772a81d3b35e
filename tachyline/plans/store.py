"""The telemetry tables: where they are, how they are laid out, how they are read.

Raw readings are partitioned by time chunk (event date and the chunk's first hour) and
by the batch that wrote them; one-minute rows by time chunk; one-hour rows by date. A
chunk is one hour unless the store says otherwise: a sparse table wants longer ones.
Finer directories would give small files at no gain, since compacted rows are sorted
inside a chunk and row-group statistics narrow a scan further. There is one writer per
table.

A batch of few readings in very many chunks would be files of a few rows. Its chunks of one date share a batch
directory instead, whose ``event_hour`` is a negative number: bit h says that it may hold readings of the chunk
that begins at hour h. Names alone still tell which batches a chunk has, a batch's chunk is in one directory
only, and rows are read with the hour of their own chunk. Where a part of such chunks is to be merged or dropped,
``split`` gives each of them its own directory first.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tachyline.functions.time import instant
from tachyline.plans.files import Files, chunk_dir, chunks_of, day_of, hours_code, side_by_side
from tachyline.plans.sizing import broadcast_if_small
from tachyline.schemas import INGEST_METRIC, SERIES, small_table

RESOLUTIONS = {"ONE_MINUTE": "rollup_1m", "ONE_HOUR": "rollup_1h"}

_READING = "car_id string, sensor_id string, event_time {ts}, value double, sequence_no bigint, arrival bigint"
_ROLLUP = (
    "car_id string, sensor_id string, bucket {ts}, samples bigint, average double, minimum double, maximum double"
)
_PARTITIONS = {
    "raw": "event_date date, event_hour int, batch_id bigint",
    "archive": "event_date date, event_hour int, batch_id bigint",
    "rollup_1m": "bucket_date date, bucket_hour int",
    "rollup_1h": "bucket_date date",
    "rollup_1m_states": "bucket_date date, bucket_hour int, part bigint",
}
_STATE = (
    "car_id string, sensor_id string, bucket {ts}, samples bigint, total double, minimum double, maximum double"
)
_MARK = "chunk string, batch bigint, bound string"
_COVERAGE = "chunk string, revision bigint, batches string, parts string"
# Delta-packed integers and timestamps: sorted times and counters shrink to almost
# nothing, and both Spark's vectorised reader and writer handle them.
FILE_OPTIONS = {"compression": "zstd", "parquet.writer.version": "v2"}
#: A write to more directories than this is cut along them; a task then writes about ``DIRECTORIES_A_TASK`` files.
MOST_REBALANCED = 32
DIRECTORIES_A_TASK = 8
ROWS_A_TASK = 1_000_000
#: A batch in more chunks than this, with fewer rows than ``SPARSE_ROWS`` a chunk, shares directories within a date.
MOST_CHUNK_DIRECTORIES = 128
SPARSE_ROWS = 10_000
#: Beyond this many dates one listing of the table is cheaper than one for each date.
MOST_LISTED = 64
READING_COLUMNS = ["car_id", "sensor_id", "event_time", "value", "sequence_no", "arrival"]


@dataclass(frozen=True)
class Coverage:
    """What the partial states of a chunk stand for: which batches, in which parts; -1: never built."""

    revision: int = -1
    batches: frozenset[int] = frozenset()
    parts: tuple[int, ...] = ()


@dataclass(frozen=True)
class Directory:
    """A batch directory of the raw table or the archive; ``code`` is its hour, or the hours that share it."""

    day: dt.datetime
    code: int
    batch: int

    @property
    def chunks(self) -> list[dt.datetime]:
        return chunks_of(self.day, self.code)

    @property
    def shared(self) -> bool:
        return self.code < 0

    @property
    def name(self) -> str:
        return f"{hour_dir(self.day, self.code)}/batch_id={self.batch}"

    @staticmethod
    def named(name: str) -> "Directory":
        day, code, batch = name.split("/")
        return Directory(day_of(day), int(code.split("=")[1]), int(batch.split("=")[1]))


def hour_dir(day: dt.datetime, code: int) -> str:
    return f"event_date={day:%Y-%m-%d}/event_hour={code}"


def shared_codes(store: "Store", touched: Iterable[dt.datetime], n_rows: int) -> dict[dt.date, int]:
    """Codes of the dates whose chunks share a directory in a batch of ``n_rows`` in the ``touched`` chunks; mostly none.

    The newest date's chunks don't share: more of their readings are yet to come.
    """
    hours: dict[dt.date, list[int]] = {}
    for start in touched:
        hours.setdefault(start.date(), []).append(start.hour)
    chunks = sum(map(len, hours.values()))
    if chunks <= MOST_CHUNK_DIRECTORIES or n_rows >= SPARSE_ROWS * chunks:
        return {}
    newest = max(hours)
    return {day: hours_code(some) for day, some in hours.items() if day != newest and len(some) > 1}


def _ranges(numbers: frozenset[int]) -> str:
    """Ascending runs of numbers as first:last, comma-joined."""
    runs: list[list[int]] = []
    for number in sorted(numbers):
        if runs and number == runs[-1][1] + 1:
            runs[-1][1] = number
        else:
            runs.append([number, number])
    return ",".join(f"{first}:{last}" for first, last in runs)


def _numbers(text: str) -> frozenset[int]:
    bounds = [run.split(":") for run in text.split(",") if run]
    return frozenset(number for first, last in bounds for number in range(int(first), int(last) + 1))


@dataclass(frozen=True)
class Store:
    """Paths and schemas of one set of tables below ``root``.

    ``zoned`` says whether times are instants (``timestamp``) or, as in the
    benchmark tables, zone-less (``timestamp_ntz``). ``chunk_hours`` divides 24.
    """

    spark: SparkSession
    root: str
    zoned: bool = True
    chunk_hours: int = 1

    @property
    def chunk(self) -> dt.timedelta:
        return dt.timedelta(hours=self.chunk_hours)

    def _chunk_hour(self, column: str) -> Column:
        hour = F.hour(column)
        return hour if self.chunk_hours == 1 else hour - hour % self.chunk_hours

    def with_event_chunk(self, readings: DataFrame) -> DataFrame:
        """Readings with the partition columns of their time chunk."""
        return readings.withColumn("event_date", F.to_date("event_time")).withColumn(
            "event_hour", self._chunk_hour("event_time")
        )

    def with_bucket_chunk(self, minutes: DataFrame) -> DataFrame:
        """One-minute rows with the partition columns of their time chunk."""
        return minutes.withColumn("bucket_date", F.to_date("bucket")).withColumn(
            "bucket_hour", self._chunk_hour("bucket")
        )

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def schema(self, table: str) -> str:
        row = _STATE if table.endswith("_states") else _ROLLUP if table.startswith("rollup") else _READING
        return f"{row.format(ts='timestamp' if self.zoned else 'timestamp_ntz')}, {_PARTITIONS[table]}"

    def create(self) -> "Store":
        """All tables, empty. Existing ones are left alone."""
        files = Files(self.spark)
        for table in (*_PARTITIONS, "metrics"):
            files.make(self.path(table))
        return self

    def read(self, table: str) -> DataFrame:
        """The whole table; an empty one has its schema."""
        return self.read_paths(table, [self.path(table)])

    def read_paths(self, table: str, paths: Sequence[str]) -> DataFrame:
        """Directories or files of the table; rows of a shared directory have the hour of their own chunk."""
        if not paths:
            return self.spark.createDataFrame([], self.schema(table))
        reader = self.spark.read.schema(self.schema(table)).option("basePath", self.path(table))
        rows = reader.parquet(*paths)
        if "event_hour" not in rows.columns:
            return rows
        hour = F.col("event_hour")
        return rows.withColumn("event_hour", F.when(hour < 0, self._chunk_hour("event_time")).otherwise(hour))

    def rollups(self, resolution: str = "ONE_MINUTE") -> DataFrame:
        """The aggregate that answers queries of this resolution."""
        return self.read(RESOLUTIONS[resolution])

    def metrics(self) -> DataFrame:
        return self.spark.read.schema(INGEST_METRIC).parquet(self.path("metrics")).drop("batch")

    def chunks(self, table: str = "raw") -> list[dt.datetime]:
        """Start of every chunk that has a directory: metadata only."""
        return Files(self.spark).chunks(self.path(table), *_chunk_names(table))

    def chunk_path(self, table: str, start: dt.datetime) -> str:
        return chunk_dir(self.path(table), start, *_chunk_names(table))

    def directories(self, table: str, chunks: Iterable[dt.datetime] | None = None) -> list[Directory]:
        """Batch directories of the raw table or the archive; only those that hold some of ``chunks``, if given."""
        files, root, below = Files(self.spark), self.path(table), ("event_hour=*", "batch_id=*")
        wanted = None if chunks is None else set(chunks)
        days = None if wanted is None else sorted({f"event_date={start:%Y-%m-%d}" for start in wanted})
        if days is None or len(days) > MOST_LISTED:
            names = files.below(root, "event_date=*", *below)
        else:
            names = [f"{day}/{name}" for day in days for name in files.below(f"{root}/{day}", *below)]
        found = [Directory.named(name) for name in names]
        return [held for held in found if wanted is None or not wanted.isdisjoint(held.chunks)]

    def batches(self, table: str, chunks: Iterable[dt.datetime] | None = None) -> dict[dt.datetime, list[int]]:
        """Ids of the batches of each chunk, by directory names; a chunk without any is left out."""
        wanted = None if chunks is None else set(chunks)
        found: dict[dt.datetime, list[int]] = {}
        for held in self.directories(table, wanted):
            for start in held.chunks:
                if wanted is None or start in wanted:
                    found.setdefault(start, []).append(held.batch)
        return dict(sorted(found.items()))

    def _hour_directories(self, table: str, chunks: set[dt.datetime]) -> dict[str, set[dt.datetime]]:
        """Directories of the dates of ``chunks``, and the chunks each holds."""
        files, (date, hour), root = Files(self.spark), _chunk_names(table), self.path(table)
        days = {f"{date}={start:%Y-%m-%d}" for start in chunks}
        if len(days) > MOST_LISTED:
            names = [name for name in files.below(root, f"{date}=*", f"{hour}=*") if name.split("/")[0] in days]
        else:
            names = [f"{day}/{name}" for day in sorted(days) for name in files.below(f"{root}/{day}", f"{hour}=*")]
        split = {name: name.split("/") for name in names}
        return {name: set(chunks_of(day_of(day), int(code.split("=")[1]))) for name, (day, code) in split.items()}

    def read_chunks(self, table: str, chunks: Sequence[dt.datetime]) -> DataFrame:
        """Only the given chunks, without listing the rest of the table."""
        (date, hour), root, wanted = _chunk_names(table), self.path(table), set(chunks)
        held: dict[str, dict[str, set[dt.datetime]]] = {}
        for name, starts in self._hour_directories(table, wanted).items():
            held.setdefault(name.split("/")[0], {})[name] = starts
        paths, partly = [], []
        for day, some in held.items():
            # A date that is wanted as a whole is one path, not one for each of its chunks.
            if all(starts <= wanted for starts in some.values()):
                paths.append(f"{root}/{day}")
                continue
            paths += [f"{root}/{name}" for name, starts in some.items() if starts <= wanted]
            partly += [name for name, starts in some.items() if not starts <= wanted and not starts.isdisjoint(wanted)]
        rows = self.read_paths(table, paths)
        if not partly:
            return rows
        starts = set().union(*(held[name.split("/")[0]][name] for name in partly)) & wanted
        keys = [(start.date(), start.hour) for start in sorted(starts)]
        return self._with_part(rows, table, [f"{root}/{name}" for name in partly], keys, f"{date} date, {hour} int")

    def _with_part(self, rows: DataFrame, table: str, paths: list[str], keys: list[tuple], ddl: str) -> DataFrame:
        """``rows`` and, of the shared directories at ``paths``, the rows with one of the keys."""
        names = [field.strip().split(" ")[0] for field in ddl.split(",")]
        part = self.read_paths(table, paths).join(broadcast_if_small(small_table(self.spark, keys, ddl)), names, "left_semi")
        return rows.unionByName(part.select(*rows.columns))

    def read_parts(self, table: str, column: str, parts: dict[dt.datetime, Sequence[int]]) -> DataFrame:
        """Only the named directories ``column=part`` of the given chunks."""
        if column != "batch_id":
            files = Files(self.spark)
            paths = [f"{self.chunk_path(table, start)}/{column}={part}" for start, some in parts.items() for part in some]
            return self.read_paths(table, [path for path in paths if files.exists(path)])
        paths, partly, keys = [], [], []
        for held in self.directories(table, parts):
            wanted = [start for start in held.chunks if held.batch in parts.get(start, ())]
            if len(wanted) == len(held.chunks):
                paths.append(f"{self.path(table)}/{held.name}")
            elif wanted:
                partly.append(f"{self.path(table)}/{held.name}")
                keys += [(start.date(), start.hour, held.batch) for start in wanted]
        rows = self.read_paths(table, paths)
        return self._with_part(rows, table, partly, keys, "event_date date, event_hour int, batch_id bigint") if partly else rows

    def rollups_between(
        self, resolution: str, start: str | dt.datetime, end: str | dt.datetime
    ) -> DataFrame:
        """The directories of an aggregate that can hold buckets in [start, end), and no others.

        One listing names the dates. Whole dates are read as one directory each; of the
        first and the last date only the chunks inside the range.
        """
        table, since, until = RESOLUTIONS[resolution], instant(start), instant(end)
        files, root = Files(self.spark), self.path(RESOLUTIONS[resolution])
        paths = []
        for name in files.children(root):
            if not name.startswith("bucket_date=") or since >= until:
                continue
            day = dt.datetime.fromisoformat(name.split("=", 1)[1])
            if day + dt.timedelta(days=1) <= since or day >= until:
                continue
            if table == "rollup_1h" or (day >= since and day + dt.timedelta(days=1) <= until):
                paths.append(f"{root}/{name}")
                continue
            for part in files.children(f"{root}/{name}"):
                hour = day + dt.timedelta(hours=int(part.split("=")[1])) if part.startswith("bucket_hour=") else None
                if hour is not None and hour + self.chunk > since and hour < until:
                    paths.append(f"{root}/{name}/{part}")
        if not paths:
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).option("basePath", root).parquet(*paths)

    def _noted(self, name: str, schema: str) -> list:
        """Rows of the last complete version of a small note beside the tables."""
        files, root = Files(self.spark), f"{self.root}/refreshed/{name}"
        for version in sorted(files.children(root), reverse=True):
            if files.exists(f"{root}/{version}/_SUCCESS"):
                return self.spark.read.schema(schema).parquet(f"{root}/{version}").collect()
        return []

    def _note(self, name: str, rows: list[tuple], schema: str) -> None:
        """Replace a note. Versions: a crash leaves the last complete one in force."""
        files, root = Files(self.spark), f"{self.root}/refreshed/{name}"
        old = sorted(files.children(root))
        number = int(old[-1].split("=")[1]) + 1 if old else 0
        small_table(self.spark, rows, schema).coalesce(1).write.parquet(f"{root}/version={number:012d}")
        for version in old:
            files.delete(f"{root}/{version}")

    def marks(self, table: str) -> dict[dt.datetime, tuple[int, dt.datetime]]:
        """How far an aggregate has been refreshed: chunk -> (revision of its source, upper bound)."""
        parse = dt.datetime.fromisoformat
        rows = self._noted(table, _MARK)
        return {parse(row["chunk"]): (row["batch"], parse(row["bound"])) for row in rows}

    def set_marks(self, table: str, marks: dict[dt.datetime, tuple[int, dt.datetime]]) -> None:
        rows = [(start.isoformat(), batch, bound.isoformat()) for start, (batch, bound) in sorted(marks.items())]
        self._note(table, rows, _MARK)

    def coverage(self) -> dict[dt.datetime, Coverage]:
        """Which batches of each chunk the partial states of the one-minute aggregate hold."""
        return {
            dt.datetime.fromisoformat(row["chunk"]): Coverage(
                row["revision"], _numbers(row["batches"]), tuple(int(part) for part in row["parts"].split(",") if part)
            )
            for row in self._noted("coverage", _COVERAGE)
        }

    def set_coverage(self, coverage: dict[dt.datetime, Coverage]) -> None:
        rows = [
            (start.isoformat(), held.revision, _ranges(held.batches), ",".join(map(str, held.parts)))
            for start, held in sorted(coverage.items())
        ]
        self._note("coverage", rows, _COVERAGE)

    def replace(self, rows: DataFrame, table: str, spread: Column | None = None, directories: int = 0) -> None:
        """``write``, but staged and swapped in directory by directory.

        A dynamic overwrite deletes before it renames. Here the old directory is parked until
        the new one stands, and ``recover`` finishes a swap that a crash cut short. For
        aggregates: what they were made from may be gone.
        """
        files, depth = Files(self.spark), len(_PARTITIONS[table].split(","))
        staged = f"{self.root}/swap/staged/{uuid.uuid4().hex[:12]}"
        self.write(rows, table, spread, staged, directories)

        def swap(leaf: str) -> None:
            live, old = f"{self.path(table)}/{leaf}", f"{self.root}/swap/{table}/{leaf}"
            if files.exists(live):
                files.rename(live, old)
            files.rename(f"{staged}/{leaf}", live)
            files.delete(old)

        side_by_side(swap, files.leaves(staged, depth))
        files.delete(staged)

    def recover(self, table: str) -> None:
        """Finish or undo the swaps of ``replace`` that a crash interrupted."""
        files, parked = Files(self.spark), f"{self.root}/swap/{table}"
        for leaf in files.leaves(parked, len(_PARTITIONS[table].split(","))):
            files.finish_swap(f"{self.path(table)}/{leaf}", f"{parked}/{leaf}")

    def split(self, table: str, shared: Sequence[Directory]) -> None:
        """Give each chunk of the shared directories its own.

        A shared directory is parked while its chunks' own are put in place. Until it is taken off in one
        rename, ``recover_shared`` undoes what a crash cut short: no other directory holds these rows.
        """
        if not shared:
            return
        files, live = Files(self.spark), self.path(table)
        staged = f"{self.root}/swap/staged/{uuid.uuid4().hex[:12]}"
        rows = self.read_paths(table, [f"{live}/{held.name}" for held in shared])
        self.write(rows, table, path=staged, directories=sum(len(held.chunks) for held in shared))

        def swap(held: Directory) -> None:
            parked = f"{self.root}/swap/shared/{table}/{held.name}"
            files.rename(f"{live}/{held.name}", parked)
            for start in held.chunks:
                own = Directory(held.day, start.hour, held.batch).name
                if files.exists(f"{staged}/{own}"):
                    files.rename(f"{staged}/{own}", f"{live}/{own}")
            files.rename(parked, f"{self.root}/swap/done/{uuid.uuid4().hex[:12]}")

        side_by_side(swap, shared)
        for name in {hour_dir(held.day, held.code) for held in shared}:
            files.delete_empty(f"{live}/{name}")
        files.delete(staged)
        files.delete(f"{self.root}/swap/done")

    def recover_shared(self, table: str) -> None:
        """Undo a ``split`` that a crash cut short."""
        files, parked, live = Files(self.spark), f"{self.root}/swap/shared/{table}", self.path(table)
        for name in files.below(parked, "event_date=*", "event_hour=*", "batch_id=*"):
            held = Directory.named(name)
            for start in held.chunks:
                own = Directory(held.day, start.hour, held.batch).name
                files.delete(f"{live}/{own}")
                files.delete_empty(f"{live}/{own.rsplit('/', 1)[0]}")
            files.rename(f"{parked}/{name}", f"{live}/{name}")

    def drop_chunks(self, table: str, chunks: Iterable[dt.datetime], batch: int | None = None) -> None:
        """Drop the chunks, or what one batch has in them, by directory; shared ones that hold others are split first."""
        files, root, wanted = Files(self.spark), self.path(table), set(chunks)
        partly = [held for held in self.directories(table, wanted) if held.shared and not wanted.issuperset(held.chunks)]
        self.split(table, [held for held in partly if batch in (None, held.batch)])
        if batch is None:
            names = [name for name, starts in self._hour_directories(table, wanted).items() if starts <= wanted]
        else:
            names = [held.name for held in self.directories(table, wanted) if held.batch == batch]
        side_by_side(lambda name: files.delete(f"{root}/{name}"), names)
        for above in {name.rsplit("/", 1)[0] for name in names if batch is not None}:
            files.delete_empty(f"{root}/{above}")

    def write(
        self, rows: DataFrame, table: str, spread: Column | None = None, path: str | None = None,
        directories: int = 0, n_rows: int = 0,
    ) -> None:
        """Replace the partitions that ``rows`` holds; all others stay.

        ``spread`` splits each partition over that many values, so that a hot chunk
        is not written by one task. With adaptive execution the rebalance hint
        also splits oversized and joins undersized output. It goes by bytes: rows for many ``directories``
        (about how many, if known) would all be written by one task, file after file, or
        each directory by all tasks. Those are cut along the directories instead, into ``tasks_for`` ranges.
        """
        partitions = [part.strip().split(" ")[0] for part in _PARTITIONS[table].split(",")]
        by = list(partitions)
        if spread is not None:
            rows, by = rows.withColumn("_salt", spread), [*by, "_salt"]
        # Sorted files give selective row-group statistics, and the writer needs the
        # leading partition columns in order anyway.
        time = "bucket" if table.startswith("rollup") else "event_time"
        dealt = rows.hint("rebalance", *by)
        if directories > MOST_REBALANCED:
            dealt = rows.repartitionByRange(tasks_for(directories, n_rows), *by)
        (
            dealt.drop("_salt")
            .sortWithinPartitions(*partitions, *SERIES, time)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .options(**FILE_OPTIONS)
            .partitionBy(*partitions)
            .parquet(path or self.path(table))
        )


def tasks_for(directories: int, n_rows: int = 0) -> int:
    """Tasks that write rows cut along their directories; a directory of many rows is cut in turn."""
    return max(-(-directories // DIRECTORIES_A_TASK), -(-n_rows // ROWS_A_TASK))


def _chunk_names(table: str) -> tuple[str, str]:
    return ("bucket_date", "bucket_hour") if table.startswith("rollup_1m") else ("event_date", "event_hour")


def salt(width: int, *columns: str) -> Column:
    """A small hash of ``columns``: spreads one partition over ``width`` writers."""
    return F.pmod(F.xxhash64(*columns), F.lit(width))
