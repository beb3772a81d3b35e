"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tachyline.plans.files import scratch_path

#: Rows that Python works on at once, below what an Arrow batch may hold.
ROWS_AT_ONCE = 512
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back: its lineage ends here."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Store:
    """Files of a shared folder as seen from a task: a mounted path, or a store that Arrow can open."""

    def __init__(self, folder: str):
        parsed = urlparse(folder)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root = parsed.path
        else:
            from pyarrow import fs

            self.files, self.root = fs.FileSystem.from_uri(folder)

    def create(self, name: str):
        """A writable file under a name of its own; ``publish`` gives it its final name."""
        temporary = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            return temporary, open(temporary, "wb")  # noqa: SIM115
        self.files.create_dir(self.root, recursive=True)
        return temporary, self.files.open_output_stream(temporary)

    def publish(self, temporary: str, name: str) -> None:
        target = f"{self.root}/{name}"
        if self.local:
            os.replace(temporary, target)
        else:
            self.files.move(temporary, target)

    def map(self, name: str, dtype: str):
        """The file as an array: memory-mapped where the folder is mounted, read otherwise."""
        import numpy as np

        path = f"{self.root}/{name}"
        if self.local:
            return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
        with self.files.open_input_file(path) as source:
            return np.frombuffer(source.read_buffer(), dtype=dtype)


_HELD: dict = {}


def held(key: tuple, build):
    """The one large thing that a Python worker keeps from task to task; another takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Let go of what an earlier operator's tasks have left in this Python worker."""
    _HELD.clear()


def in_arrow(frame: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches of ARROW_BYTES at most, from now on in this session.

    A batch is held by the JVM and by Python at once, on its way in and on its way out; with
    whole texts the default of 64 MB would be a large part of an executor's memory.
    """
    conf, name = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(name, None) or "").rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return frame.mapInArrow(function, schema)


def mapped(docs: DataFrame, keep: list[str], inputs: list[Column], results: str, worker) -> DataFrame:
    """Python over Arrow batches: the kept columns as a struct ``row``, untouched, beside the results.

    ``worker()`` is called once per task and returns a function from the input arrays of a batch
    to the result arrays. No column of the documents can clash with the names used inside.
    """
    kept = docs.select(*keep).schema
    results = T.StructType.fromDDL(results)
    schema = T.StructType([T.StructField("row", kept), *results.fields])
    frame = docs.select(F.struct(*keep).alias("row"), *(c.alias(f"in{i}") for i, c in enumerate(inputs)))
    names = [field.name for field in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = worker()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([some.column(0), *work(*some.columns[1:])], names=names)

    return frame.transform(in_arrow, run, schema)
