"""Frames of odd documents that every operator must take, and small helpers."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema: str = DOCUMENTS):
    """Rows of (doc_id, text[, lang]) as a table of documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def clashing(frame):
    """The same rows with columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("_rank", "_block", "_group", "length", "size", "start", "count", "piece", "shard", "words", "key"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def odd_texts() -> list[tuple[int | None, str | None]]:
    long = " ".join(f"word{i % 977} of" for i in range(60_000))
    return [
        (1, "a b c d e f"), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, "a b c d e f"), (6, "a b c d e f"),
        (7, "it's  two   spaces\n\n \nand\ttabs "), (8, "Ünïcödé ß İ 字 \U0001f600 text"), (None, "no id"),
        (None, None), (9, "a b c d e f"), (10, "x"),
    ]
