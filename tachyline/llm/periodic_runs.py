"""Periodic runs of words, found by recursive frequency splitting and a lag scan of what survives.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at
least max(SHORTEST, PERIODS * q) words that no neighbouring word extends. Each of its words occurs PERIODS
times in it or more. So a word that occurs less often in a segment of the text is in no run: it splits
the segment, and the parts are counted again, until nothing is rare any more. A segment that is
long and loses little per round goes on as it is, since the scan behind it is exact for any segment.

The lag scan takes windows of k = 1, 2, 4, ... words. For a period q with k / 2 < q <= k, a window inside a run
occurs next exactly q words further on: a nearer match would make the period smaller. A
maximal stretch of places whose windows recur next at lag q is therefore a run, from its first word to the end
of its last window's second copy. Windows of 2k words are pairs of windows of k words; a window that
occurs once is in no run of a longer period and splits its segment again. The
work is n log n a scale and shrinks with the scales; no pair of places is ever listed.

Words are compared as such, by dictionary codes, not by hashes. Null and empty texts have no words and no
runs, and collapse to the empty text. Rows with the same doc_id are documents of their own; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachyline.llm.common import in_arrow
from tachyline.llm.hashing import by_bytes

SHORTEST = 24
PERIODS = 3
WORDS = r"[^\x20\x09-\x0D]+"
BYTES_AT_ONCE = 1 << 21
#: A longer segment must lose one word in so many per round to be counted once more.
LONG_SEGMENT, LEAST_LOSS = 4096, 32


def _stretches(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and ends of the stretches that begin where ``breaks`` is true."""
    first = np.flatnonzero(breaks)
    return first, np.append(first[1:], len(breaks))


def _places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the segments, and the number of the segment that each is in."""
    lengths = ends - starts
    segment = np.repeat(np.arange(len(starts)), lengths)
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - (first - starts)[segment], segment


def segments(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the segments that may hold runs, in order."""
    kinds = int(codes.max(initial=0)) + 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long_enough = ends - starts >= SHORTEST
        starts, ends = starts[long_enough], ends[long_enough]
        if not len(starts):
            break
        at, segment = _places(starts, ends)
        _, kind, count = np.unique(segment * kinds + codes[at], return_inverse=True, return_counts=True)
        stays = count[kind] >= PERIODS
        lost = np.bincount(segment, ~stays, len(starts))
        size = ends - starts
        stable = (lost == 0) | ((size > LONG_SEGMENT) & (lost * LEAST_LOSS < size))
        done.append((starts[stable], ends[stable]))
        keep = stays & ~stable[segment]
        at, segment = at[keep], segment[keep]
        if not len(at):
            break
        breaks = np.ones(len(at), bool)
        breaks[1:] = (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])
        first, end = _stretches(breaks)
        starts, ends = at[first], at[end - 1] + 1
    starts, ends = (np.concatenate([*each, np.empty(0, np.int64)]) for each in (list(zip(*done)) or ((), ())))
    order = np.argsort(starts)
    return starts[order].astype(np.int64), ends[order].astype(np.int64)


def runs_in(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of (start, length, period) by start and period, over texts that begin at ``bounds``."""
    found = [np.empty((0, 3), np.int64)]
    at, segment = _places(*segments(codes, bounds[:-1], bounds[1:]))
    kinds = int(codes.max(initial=0)) + 1
    names = segment * kinds + codes[at]
    k = 1
    while len(at):
        _, kind, count = np.unique(names, return_inverse=True, return_counts=True)
        order = np.argsort(kind, kind="stable")
        lag = np.zeros(len(at), np.int64)
        same = kind[order[1:]] == kind[order[:-1]]
        lag[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
        lag[(lag <= k // 2) | (lag > k)] = 0
        breaks = np.ones(len(at), bool)
        breaks[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
        first, end = _stretches(breaks)
        period = lag[first]
        length = end - first - 1 + k + period
        runs = (period > 0) & (length >= np.maximum(SHORTEST, PERIODS * period))
        found.append(np.column_stack([at[first], length, period])[runs])

        # what may be in a run of a period above k: windows that recur, in stretches that are long enough
        twice = count[kind] > 1
        at, kind = at[twice], kind[twice]
        breaks = np.ones(len(at), bool)
        breaks[1:] = at[1:] != at[:-1] + 1
        first, end = _stretches(breaks)
        wide = end - first + k - 1 >= max(SHORTEST, PERIODS * (k + 1))
        stays = np.repeat(wide, end - first)
        at, kind = at[stays], kind[stays]
        beside = np.searchsorted(at, at + k)
        beside[beside == len(at)] = 0
        pair = at[beside] == at + k if len(at) else np.empty(0, bool)
        names = (kind * (int(kind.max(initial=0)) + 1) + kind[beside])[pair]
        at, k = at[pair], 2 * k
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts end to end, and where each text's words begin and end."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    values, offsets = split.values, split.offsets.to_numpy().astype(np.int64)
    filled = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])
    return values.filter(pa.array(filled)), before[offsets].astype(np.int64)


def collapsed(docs: DataFrame) -> DataFrame:
    """A row per document: its runs by start and period, and its words without the repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            texts = [range(size) for size in sizes.tolist()]  # by_bytes only asks for their lengths
            for first, end in by_bytes(texts, BYTES_AT_ONCE):
                some = batch.slice(first, end - first)
                words, bounds = words_of(some.column(1))
                codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                runs = runs_in(codes, bounds)
                steps = np.zeros(len(codes) + 1, np.int64)
                np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
                np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
                stays = np.cumsum(steps[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(stays)])[bounds]
                lists = pa.ListArray.from_arrays(
                    pa.array(kept, pa.int32()), words.filter(pa.array(stays)) if not stays.all() else words
                )
                of = np.searchsorted(bounds, runs[:, 0], "right") - 1
                rows = pa.StructArray.from_arrays(
                    [pa.array(runs[:, 0] - bounds[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])],
                    names=["start", "length", "period"],
                )
                held = np.searchsorted(of, np.arange(some.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(held, pa.int32()), rows),
                        pc.binary_join(lists, " "),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, work, schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten, by the checksum of its id, goes round in its own words."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h")
    )
    chosen = (F.col("h") % 10 == 0) & F.col("text").rlike(WORDS)
    rows = rows.withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(chosen, F.expr("g % n"))).withColumn(
        "p", F.when(chosen, 1 + F.expr("(n - a) div (3 + g % 8)"))
    )
    turned = F.expr("array_join(transform(sequence(0L, n - 1L), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return rows.select("doc_id", F.when(chosen, turned).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """A row per document: how many runs, the one with the most periods, checksums of runs and collapsed text."""
    best = F.expr(
        "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), "
        "(best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best))"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return collapsed(with_repeats(docs)).withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
