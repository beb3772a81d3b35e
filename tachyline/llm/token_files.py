"""Token-id files: flat unsigned integers, 64-bit document offsets, partition bases by prefix sums.

A file set has one group of files per partition of the documents in ascending order of id:

    part-00000.ids   token ids of its documents, end to end, unsigned 16-bit where the
                     vocabulary fits and 32-bit otherwise, little-endian
    part-00000.off   unsigned 64-bit: where each document starts in that file, and its end
    part-00000.doc   signed 64-bit document ids

and a manifest with a row per partition. The partitions are written in parallel, so none knows
how many ids come before it; the manifest's bases are prefix sums over the partitions' counts.

Null text is an empty one, which still has its end id. Rows whose doc_id is null come first
(the manifest counts them); rows that share a doc_id follow each other in the order of their
texts. Other columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tachyline.llm.common import Store, in_arrow, stored
from tachyline.llm.encoding import shared_encoder
from tachyline.plans.files import scratch_path

MANIFEST = "part int, n_docs long, n_null long, n_ids long, width int"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"
DOCS_AT_ONCE = 256


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None
) -> DataFrame:
    """Write the documents' ids below ``folder``; returns the manifest with each part's bases."""
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(count, "doc_id", F.crc32("text"))
        .sortWithinPartitions("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = shared_encoder(tokenizer, end_id)
        narrow = max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        store, part = Store(folder), TaskContext.get().partitionId()
        name, files, lengths, nulls, n_docs, n_ids = f"part-{part:05d}", {}, [], 0, 0, 0
        for batch in batches:
            if not files:
                files = {kind: store.create(f"{name}.{kind}") for kind in ("ids", "off", "doc")}
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(at, DOCS_AT_ONCE)
                encoded = encoder.encode([text or "" for text in some.column(1).to_pylist()])
                ids = np.frombuffer(b"".join(encoded), "<u4")
                files["ids"][1].write((ids.astype("<u2") if narrow else ids).tobytes())
                lengths = np.array([len(each) // 4 for each in encoded], "<u8")
                files["off"][1].write((np.cumsum(lengths) - lengths + n_ids).astype("<u8").tobytes())
                files["doc"][1].write(some.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
                nulls += some.column(0).null_count
                n_docs, n_ids = n_docs + some.num_rows, n_ids + len(ids)
        if not n_docs:
            for _, file in files.values():
                file.close()
            return
        files["off"][1].write(np.array([n_ids], "<u8").tobytes())
        for kind, (temporary, file) in files.items():
            file.close()
            store.publish(temporary, f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part], pa.int32()),
                "n_docs": pa.array([n_docs], pa.int64()),
                "n_null": pa.array([nulls], pa.int64()),
                "n_ids": pa.array([n_ids], pa.int64()),
                "width": pa.array([2 if narrow else 4], pa.int32()),
            }
        )

    parts = stored(rows.transform(in_arrow, write, MANIFEST), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return parts.select(
        "*",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
    )


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document as the files hold it, its place counted over the whole set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"part-{row['part']:05d}"
                ids = store.map(f"{name}.ids", f"<u{row['width']}")
                offsets = store.map(f"{name}.off", "<u8").astype(np.int64)
                doc_ids = np.asarray(store.map(f"{name}.doc", "<i8"))
                for at in range(0, row["n_docs"], 4096):
                    bounds = offsets[at : min(at + 4096, row["n_docs"]) + 1]
                    wide = memoryview(np.asarray(ids[bounds[0] : bounds[-1]]).astype("<u4").tobytes())
                    local = ((bounds - bounds[0]) * 4).tolist()
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(local, local[1:])]
                    null = np.arange(at, at + len(crc)) < row["n_null"]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(doc_ids[at : at + len(crc)].astype(np.int64), mask=null),
                            "start": pa.array(bounds[:-1] + row["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    count = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(count, "part").transform(in_arrow, read, DOCUMENT)


def encoded_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files into the shared scratch folder and read every document back."""
    folder = scratch_path(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
