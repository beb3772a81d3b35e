"""Secrets by patterns, and by two character Markov models compared by log-likelihood ratio.

Three patterns find the base secrets. The method adds strings that no pattern covers: every
maximal run of key characters that holds a digit and a letter, of MIN_RUN characters or more and
clear of the base spans, is scored under a first-order Markov model of random strings and one of
ordinary identifiers. It is a secret if the ratio reaches MIN_BITS_A_CHARACTER per character.

Both models are trained here, on two labelled samples drawn by hash: random strings are those inside base
spans of about SAMPLE_DOCS of the documents that hold any, however rare these are, and ordinary ones the runs
outside base spans of about SAMPLE_DOCS of all documents, but for those that are
themselves to be judged, which teach neither model. Counts start
from PRIOR for every pair of characters, so a model without samples is uniform; without any
random samples the method adds nothing.

Positions are code points, ends exclusive, over the whole text. Null text is an empty one and has
no secrets. Rows that share a doc_id are scanned one by one. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachyline.llm.common import in_arrow, mapped

KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
MIN_BITS_A_CHARACTER = 1.0
SAMPLE_DOCS = 4000
PRIOR = 0.5

#: Key characters; "?" stands before the first.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = {character: i + 1 for i, character in enumerate(ALPHABET)}
_WIDTH = len(ALPHABET) + 1

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_MAYBE_ASSIGN = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run: the shorter ones are dropped anyway
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_SAMPLE_RUN = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns, leftmost and non-overlapping within each kind."""
    out: list[Span] = []
    small = text.lower()
    if any(word in small for word in _MAYBE_ASSIGN):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0])))


def outside(spans: list[Span], start: int, end: int) -> bool:
    return all(end <= a or start >= b for _, a, b in spans)


def is_candidate(run: str) -> bool:
    return len(run) >= MIN_RUN and bool(_DIGIT.search(run) and _LETTER.search(run))


def codes(run: str) -> list[int]:
    return [_CODE[character] for character in run]


@dataclass(frozen=True)
class Ratio:
    """Bits by which the random model beats the ordinary one, for each pair of characters."""

    bits: np.ndarray

    def a_character(self, run: str) -> float:
        path = codes(run)
        return float(self.bits[[0, *path[:-1]], path].mean())


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Ratio | None:
    """Count pairs of characters in random and ordinary runs of bounded samples of documents."""

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents, and those that hold random strings."""
        total = some = 0
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0).to_pylist():
                some += bool(text and secret_values(text, base_spans(text)))
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([some])], names=["total", "some"])

    counted = docs.select("text").transform(in_arrow, holding, "total long, some long")
    total, some = (n or 0 for n in counted.agg(F.sum("total"), F.sum("some")).first())
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    ordinary, random = draw * max(total, 1) < sample_docs, draw * max(some, 1) < sample_docs
    sample = docs.select("text", ordinary.alias("ordinary")).filter(F.col("text").isNotNull() & random)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((2, _WIDTH, _WIDTH), np.int64)
        for batch in batches:
            for text, drawn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text)
                for run in _SAMPLE_RUN.finditer(text) if drawn else ():
                    if outside(spans, *run.span()) and not is_candidate(run.group()):
                        path = codes(run.group())
                        np.add.at(pairs[1], ([0, *path[:-1]], path), 1)
                for value in secret_values(text, spans):
                    path = codes(value)
                    np.add.at(pairs[0], ([0, *path[:-1]], path), 1)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pairs.reshape(-1)[at])], names=["cell", "n"])

    rows = sample.transform(in_arrow, count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(2 * _WIDTH * _WIDTH)
    for row in rows:
        pairs[row["cell"]] = row["n"]
    pairs = pairs.reshape(2, _WIDTH, _WIDTH)
    if not pairs[0].any():
        return None
    chance = (pairs + PRIOR) / (pairs + PRIOR).sum(2, keepdims=True)
    return Ratio(np.log2(chance[0]) - np.log2(chance[1]))


def secret_values(text: str, spans: list[Span]) -> list[str]:
    """The key characters of the base matches that look random: long, with a digit and a letter."""
    out = []
    for kind, start, end in spans:
        value = text[start:end]
        if kind == "assign":
            value = _ASSIGN.match(value).group(2)
        out += [run for run in _SAMPLE_RUN.findall(value) if len(run) >= 16 and _DIGIT.search(run) and _LETTER.search(run)]
    return out


def all_spans(text: str, ratio: Ratio | None) -> list[Span]:
    spans = base_spans(text)
    if ratio is None:
        return spans
    added = [
        ("random", *run.span())
        for run in _RUN.finditer(text)
        if is_candidate(run.group()) and outside(spans, *run.span())
        and ratio.a_character(run.group()) >= MIN_BITS_A_CHARACTER
    ]
    return in_order(spans + added) if added else spans


def find_secrets(docs: DataFrame, ratio: Ratio | None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of each document as ``row``, with its spans in order."""

    def worker():
        def work(texts):
            found = [all_spans(text or "", ratio) for text in texts.to_pylist()]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]
            kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            return [pa.array(rows, pa.list_(kind))]

        return work

    schema = "spans array<struct<kind:string,start:long,end:long>>"
    return mapped(docs, keep or docs.columns, [F.col("text")], schema, worker)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    found = find_secrets(docs, train(docs), ["doc_id"])

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select(
        "row.doc_id",
        number(KINDS[0]).alias("n_assign"),
        number(KINDS[1]).alias("n_access"),
        number(KINDS[2]).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
