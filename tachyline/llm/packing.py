"""Best-fit packing of documents into token sequences, after Martello and Toth's reduction.

A document longer than a sequence is cut into full pieces behind a first, shorter one; every
piece is then an item of a bin-packing problem. Items of one length are alike, so the problem
is a histogram with at most ``capacity`` bars, whatever the number of documents. The reduction
and the packing work on that histogram and on bins that hold the same lengths, many at once;
the driver never sees a document. What comes out says, for each length, which run of its
pieces goes to which run of sequences and at which offset, and every piece finds its place
from its rank among the pieces of its length.

Null text is an empty one: a piece with the end id alone. Rows that share a doc_id are
packed as documents of their own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tachyline.llm.common import in_arrow, stored
from tachyline.llm.encoding import shared_encoder

CAPACITY = 1024
PIECES_A_BLOCK = 4_000
DOCS_AT_ONCE = 256
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: lengths with how often each is held, as ((length, times), ...)
Pattern = tuple[tuple[int, int], ...]


def reduced(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix every set that dominates all others its longest piece could go with; ``counts`` shrinks.

    For a piece of length s and the room beside it, the set dominates if
    nothing fits (s alone); or one piece fills the room to the last token; or at most one more
    piece fits (the longest that does); or at most two fit and the longest single one is no
    shorter than the best pair. Sets are fixed as often as their lengths last.
    """
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for size in range(capacity, 0, -1):
            while counts[size]:
                counts[size] -= 1
                room = capacity - size
                present = np.flatnonzero(counts[: room + 1])
                partner = int(present[-1]) if len(present) else 0
                sure = not partner or partner == room
                if not sure:
                    smallest = np.repeat(present[:3], np.minimum(counts[present[:3]], 3))[:3]
                    if len(smallest) < 2 or smallest[:2].sum() > room:
                        sure = True
                    elif len(smallest) < 3 or smallest.sum() > room:
                        sure = partner >= _best_pair(counts, present, room)
                counts[size] += 1
                if not sure:
                    break
                if not partner:
                    pattern, times = ((size, 1),), int(counts[size])
                elif partner == size:
                    pattern, times = ((size, 2),), int(counts[size] // 2)
                else:
                    pattern, times = ((size, 1), (partner, 1)), int(min(counts[size], counts[partner]))
                fixed.append((pattern, times))
                for length, held in pattern:
                    counts[length] -= held * times
                changed = True
    return fixed


def _best_pair(counts: np.ndarray, present: np.ndarray, room: int) -> int:
    best = 0
    for length in present:
        left = room - length
        others = present[: np.searchsorted(present, left, "right")]
        if len(others) and others[-1] == length and counts[length] < 2:
            others = others[:-1]
        if len(others):
            best = max(best, int(length + others[-1]))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over the histogram: each piece to the fullest sequence with room for it."""
    open_bins: list[dict[Pattern, int]] = [defaultdict(int) for _ in range(capacity + 1)]

    def add(pattern: Pattern, room: int, size: int, held: int, bins: int) -> None:
        if bins and held:
            open_bins[room - held * size][(*pattern, (size, held))] += bins

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for room in range(size, capacity):
            for pattern in list(open_bins[room]) if left else ():
                bins = open_bins[room].pop(pattern)
                held = room // size
                full = min(bins, left // held)
                add(pattern, room, size, held, full)
                left -= full * held
                rest = left if full < bins else 0
                add(pattern, room, size, rest, 1)
                left -= rest
                if bins - full - bool(rest):
                    open_bins[room][pattern] += bins - full - bool(rest)
                if not left:
                    break
        if left:
            held = capacity // size
            add((), capacity, size, held, left // held)
            add((), capacity, size, left % held, 1)
    return [(pattern, bins) for room in open_bins for pattern, bins in room.items() if bins]


def placement(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks of each length, with the first sequence and the offset each run goes to."""
    bars = np.zeros(capacity + 1, np.int64)
    for size, count in counts.items():
        bars[size] = count
    patterns = reduced(bars, capacity) + best_fit(bars, capacity)
    runs, given, sequence = [], defaultdict(int), 0
    for pattern, bins in patterns:
        offset = 0
        for size, held in pattern:
            for _ in range(held):
                runs.append((size, given[size], sequence, offset))
                given[size] += bins
                offset += size
        sequence += bins
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return {"size": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str | None, end_id: int) -> DataFrame:
    """Every document's pieces of at most ``capacity`` ids, the shorter one first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                some, rows = batch.slice(at, DOCS_AT_ONCE), []
                encoded = encoder.encode([text or "" for text in some.column(1).to_pylist()])
                for doc_id, ids in zip(some.column(0).to_pylist(), encoded):
                    view, total = memoryview(ids), len(ids) // 4
                    end = (total - 1) % capacity + 1
                    start, piece = 0, 0
                    while start < total:
                        rows.append((doc_id, piece, start, end - start, zlib.crc32(view[4 * start : 4 * end])))
                        start, end, piece = end, end + capacity, piece + 1
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, cut, PIECE)


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 2
) -> DataFrame:
    """A row per piece with its sequence and its offset there."""
    pieces = stored(pieces_of(docs, capacity, tokenizer, end_id), "pieces")
    histogram = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    blocks = sum(histogram.values()) // PIECES_A_BLOCK + 1
    runs = placement(histogram, capacity)

    order = ["doc_id", "piece", "start", "ids_crc32"]
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy("length", "_block").count()
        .select("length", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("_block", "length").orderBy(*order)
    ranked = (
        blocked.withColumn("_rank", F.row_number().over(within) - 1)
        .join(offsets, ["_block", "length"])
        .select(*order[:3], "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(runs["size"], np.arange(capacity + 2))
        span = int(runs["rank"].max(initial=0)) + 1
        keys = runs["size"] * span + runs["rank"]
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, size * span + np.minimum(rank, span - 1), "right") - 1
            at = np.clip(at, first[size], first[size + 1] - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(runs["sequence"][at] + rank - runs["rank"][at]),
                    pa.array(runs["offset"][at]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.transform(in_arrow, place, f"{PIECE}, sequence_id long, offset long")
