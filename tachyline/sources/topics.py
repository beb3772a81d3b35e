"""Topics: Kafka where its connector is installed, directories of records elsewhere.

Both give the same columns (key, value, partition, offset, timestamp), so every job
downstream is the same for either.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tachyline.plans.files import Files
from tachyline.schemas import RAW_RECORD
from tachyline.sources import wire

EVENTS, ROLLUPS, ALERTS = "telemetry.events", "telemetry.rollups", "telemetry.alerts"
PARTITIONS = {EVENTS: 12, ROLLUPS: 12, ALERTS: 3}


@dataclass(frozen=True)
class Topic:
    """A named topic on ``servers``, or below the directory ``root``.

    Several streams may publish to one topic. A broker needs to know nothing about them; a
    directory topic keeps each stream's commits apart, so it names its ``writers``.
    """

    name: str
    root: str | None = None
    servers: str | None = None
    writers: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if (self.root is None) == (self.servers is None):
            raise ValueError("give either root or servers")

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name}"

    @property
    def paths(self) -> list[str]:
        """Where a directory topic's records are."""
        return [f"{self.path}/writer={writer}" for writer in self.writers] or [self.path]

    def stream(
        self, spark: SparkSession, starting: str = "earliest", per_trigger: int | None = None, group: str | None = None
    ) -> DataFrame:
        """Subscribe. ``starting`` counts only before the first checkpoint.

        ``per_trigger`` caps a micro-batch: in records on Kafka, in files here. A directory topic is read
        from ``latest`` by a ``group``: where its partitions ended when the group first subscribed is
        kept beside the topic, so that a stopped reader misses nothing.
        """
        if self.servers is None:
            if starting not in ("earliest", "latest") or (starting == "latest" and not group):
                raise ValueError("a directory topic is read from earliest, or from latest by a group")
            reader = spark.readStream.schema(RAW_RECORD)
            if per_trigger is not None:
                reader = reader.option("maxFilesPerTrigger", per_trigger)
            records = reduce(DataFrame.unionByName, [reader.parquet(path) for path in self.paths])
            return records.filter(_after(self.start_of(spark, group))) if starting == "latest" else records
        reader = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", self.servers)
            .option("subscribe", self.name)
            .option("startingOffsets", starting)
        )
        if per_trigger is not None:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
        return reader.load().select(
            F.col("key").cast("string"), "value", "partition", "offset", "timestamp"
        )

    def ends(self, spark: SparkSession) -> dict[int, int]:
        """The last offset of each partition of a directory topic that has records."""
        ends = self.table(spark).groupBy("partition").agg(
            F.max("offset").alias("last"), F.bool_or(F.col("offset").isNull()).alias("unnumbered")
        ).collect()
        if any(row["partition"] is None or row["unnumbered"] for row in ends):
            raise ValueError(f"{self.name} holds records without partition or offset: it has no latest place")
        return {row["partition"]: row["last"] for row in ends}

    def start_of(self, spark: SparkSession, group: str) -> dict[int, int]:
        """Where the partitions ended when the group first subscribed."""
        files, path = Files(spark), f"{self.root}/_groups/{self.name}/{group}.json"
        kept = files.read_text(path)
        if kept is None:
            # Renamed into place: a crash leaves no half of it.
            kept = json.dumps({str(partition): last for partition, last in self.ends(spark).items()})
            files.write_text(f"{path}.new", kept)
            files.rename(f"{path}.new", path)
        return {int(partition): last for partition, last in json.loads(kept).items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """Everything the topic holds now, as a batch frame."""
        if self.servers is None:
            reader = spark.read.schema(RAW_RECORD)
            return reduce(DataFrame.unionByName, [reader.parquet(path) for path in self.paths])
        loaded = (
            spark.read.format("kafka")
            .option("kafka.bootstrap.servers", self.servers)
            .option("subscribe", self.name)
            .load()
        )
        return loaded.select(F.col("key").cast("string"), "value", "partition", "offset", "timestamp")

    def append(self, records: DataFrame) -> None:
        """Publish a batch of (key, value[, partition, offset, timestamp])."""
        if self.servers is None:
            records.write.mode("append").parquet(self.paths[0])
            return
        (
            records.select("key", "value").write.format("kafka")
            .option("kafka.bootstrap.servers", self.servers)
            .option("topic", self.name)
            .save()
        )

    def sink(self, records: DataFrame, checkpoint: str, writer: str | None = None) -> DataStreamWriter:
        """A writer that publishes a stream of (key, value)."""
        if self.servers is not None:
            records = records.select("key", "value")
        if "timestamp" not in records.columns:
            records = records.withColumn("timestamp", F.current_timestamp())
        path = self.path if not self.writers else f"{self.path}/writer={writer}"
        if self.writers and writer not in self.writers:
            raise ValueError(f"{writer!r} is not a writer of this topic")
        writer = records.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        if self.servers is None:
            return writer.format("parquet").option("path", path)
        return (
            writer.format("kafka")
            .option("kafka.bootstrap.servers", self.servers)
            .option("topic", self.name)
        )


def _after(ends: dict[int, int]):
    """Records behind these places; partitions that had none are read whole, and so are records without a place."""
    passed = [(F.col("partition") == partition) & (F.col("offset") <= last) for partition, last in sorted(ends.items())]
    return ~F.coalesce(reduce(lambda a, b: a | b, passed, F.lit(False)), F.lit(False))


def partition_of(key: str = "key", partitions: int = PARTITIONS[EVENTS]):
    """The partition of a keyed record: one key, one partition, so order per car."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows cut along ranges of ``by`` over as many tasks as they can keep busy.

    A table of few files or row groups is read by as few tasks, and those would encode the rows, write as
    few files to a directory topic, and so leave each of its readers as few tasks in turn.
    """
    return rows.repartitionByRange(by)


def write_events(events: DataFrame, topic: Topic, wire_format: str = "protobuf") -> None:
    """Publish readings keyed by car.

    On Kafka the broker assigns partition and offset. A directory topic records the
    partition, and the reading's arrival number as its offset.
    """
    events = dealt(events, "arrival")
    if topic.servers is not None:
        topic.append(wire.encode(events, wire_format))
        return
    records = wire.encode(events, wire_format, keep=("arrival", "event_time")).select(
        "key",
        "value",
        partition_of().alias("partition"),
        F.col("arrival").alias("offset"),
        F.col("event_time").cast("timestamp").alias("timestamp"),
    )
    topic.append(records)


def event_records(readings: DataFrame, wire_format: str = "protobuf") -> DataFrame:
    """Decoded readings as topic rows again, with the partition, offset and time they came with."""
    kept = ("topic_partition", "topic_offset", "arrived_at")
    names = dict(zip(kept, ("partition", "offset", "timestamp")))
    return wire.encode(readings, wire_format, keep=kept).withColumnsRenamed(names)


def read_events(
    spark: SparkSession, topic: Topic, wire_format: str = "protobuf",
    starting: str = "earliest", per_trigger: int | None = None, group: str | None = None,
) -> DataFrame:
    """The event topic as a decoded stream, bad records marked by ``error``."""
    return wire.decode(topic.stream(spark, starting, per_trigger, group), wire_format)


def read_rollups(spark: SparkSession, topic: Topic, starting: str | None = None) -> DataFrame:
    """The rollup topic as a stream; on Kafka from the latest offset by default."""
    return wire.json_to_rollups(topic.stream(spark, starting or _live_start(topic)))


def read_alerts(spark: SparkSession, topic: Topic, starting: str | None = None) -> DataFrame:
    """The alert topic as a stream; on Kafka from the latest offset by default."""
    return wire.json_to_alerts(topic.stream(spark, starting or _live_start(topic)))


def _live_start(topic: Topic) -> str:
    return "latest" if topic.servers is not None else "earliest"
