"""Benchmark decontamination by a prefix-filtered join of benchmark windows with documents.

A window is ``width`` consecutive words of an item, or a shorter item's all. Its words are ordered
by how rare they are in the documents. Containment must be whole, so a single prefix token, the
rarest word, is necessary: a document without it can't hold the window. Where a document has
that word, the window could only start at one place; bounds on that place and on the length
come first, and the words are then compared one by one.

The windows are taken in blocks of ``windows_a_block``: one block's index is what a task holds,
however large the benchmark is, and the documents are passed once for each block.

Null texts and texts without words have no words and are not contaminated. Items without words
have no windows; items without an id count by their hits alone and are named "" among the items.
Rows that share a doc_id are judged one by one; items that share an id count once.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachyline.llm.common import in_arrow, mapped, stored

WIDTH = 13
WINDOWS_A_BLOCK = 50_000
FINDINGS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"

#: Bytes of words: a-z, 0-9 and all of other scripts; capital letters become small ones.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct windows with the ids of their items; the words of a window are joined by spaces."""

    def worker():
        def work(texts):
            out = []
            for text in texts.to_pylist():
                words = words_of(text)
                last = max(len(words) - width, 0)
                out.append([b" ".join(words[i : i + width]) for i in range(last + 1)] if words else [])
            return [pa.array(out, pa.list_(pa.binary()))]

        return work

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    cut = mapped(items, ["item"], [F.col("text").cast("binary")], "windows array<binary>", worker)
    rows = cut.select("row.item", F.explode("windows").alias("window"))
    return rows.groupBy("window").agg(F.collect_set("item").alias("items"))


def rarity(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often the documents hold each word of the vocabulary."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(filter(vocabulary.__contains__, words_of(text)))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
            )

    counts = docs.select(F.col("text").cast("binary")).transform(in_arrow, count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def prefix_index(
    windows: dict[bytes, list[str]], counts: dict[bytes, int]
) -> dict[bytes, list[tuple[int, list[bytes], list[str]]]]:
    """Rarest word -> its place in the window, the window's words, the window's items."""
    index = defaultdict(list)
    for window, items in sorted(windows.items()):
        words = window.split(b" ")
        place = min(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
        if counts.get(words[place], 0):
            index[words[place]].append((place, words, items))
    return dict(index)


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, windows_a_block: int = WINDOWS_A_BLOCK,
                 keep: list[str] | None = None) -> DataFrame:
    """The kept columns of each document as ``row``, its number of words, hit spans of words and items."""
    keep = keep or docs.columns
    windows = stored(item_windows(benchmark, width), "windows")
    blocks = windows.count() // windows_a_block + 1
    findings = docs.select(
        F.struct(*keep).alias("row"),
        F.col("text").cast("binary").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        chosen = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block) if blocks > 1 else windows
        held = {bytes(r["window"]): sorted(r["items"]) for r in chosen.collect()}
        vocabulary = frozenset(word for window in held for word in window.split(b" "))
        index = prefix_index(held, rarity(docs, vocabulary))
        findings = _pass(findings, index)
        if block + 1 < blocks:
            findings = stored(findings, "windows-found")
    return findings.drop("text")


def _pass(findings: DataFrame, index: dict) -> DataFrame:
    """One block's hits added to what earlier blocks have found."""

    def worker():
        rare = frozenset(index)

        def work(texts, spans, items):
            counts, all_spans, all_items = [], [], []
            for text, had_spans, had_items in zip(texts.to_pylist(), spans.to_pylist(), items.to_pylist()):
                words = words_of(text)
                counts.append(len(words))
                found, hit = [(s["start"], s["end"]) for s in had_spans], set(had_items)
                if not rare.isdisjoint(words):
                    for at, word in enumerate(words):
                        for place, window, names in index.get(word, ()):
                            start = at - place
                            end = start + len(window)
                            if start >= 0 and end <= len(words) and words[start:end] == window:
                                found.append((start, end))
                                hit.update(names)
                all_spans.append([{"start": a, "end": b} for a, b in merged(found)])
                all_items.append(sorted(hit))
            return [
                pa.array(counts, pa.int64()),
                pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(all_items, pa.list_(pa.string())),
            ]

        return work

    inputs = [F.col("text"), F.col("spans"), F.col("items")]
    return mapped(findings, ["row", "text"], inputs, FINDINGS, worker).select(
        "row.row", "row.text", "n_words", "spans", "items"
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def with_verdict(findings: DataFrame) -> DataFrame:
    """Hit words, and whether they are a twentieth of the document or more."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return findings.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return with_verdict(find_windows(docs, benchmark, keep=["doc_id"])).select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    return with_verdict(find_windows(docs, benchmark)).filter(~F.col("contaminated")).select("row.*")
