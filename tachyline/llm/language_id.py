"""Language identification by prediction by partial matching, under frozen statistics.

Each language has a context tree over bytes. A context of up to ``depth`` bytes gives a byte the
probability count / (n + q) if it has followed that context in training, n being all such counts
and q the number of different bytes; the rest, q / (n + q), is the escape, shared among the other
bytes in proportion to what the next shorter context gives them (bytes seen already excluded). The
shortest context escapes to the uniform distribution. These are proper distributions, so the code
length of a text, the sum of -log2 of its bytes' probabilities, is exact; the language with the
shortest one is predicted, and the score is its posterior probability under equal priors.

The trees of all languages share their contexts, the most frequent ones in training, and each
context's code lengths are worked out once, in 1/1024 bits as integers: a text's sums don't
depend on how the texts are split into batches. ASCII capitals count as small letters.

Training takes whole texts of about ``docs_a_language`` labelled documents for each language,
drawn by hash, and the ``most_languages`` most frequent languages. ``und`` with score 0 is
predicted for null text and text without a letter, and for all texts if nothing was learned.
Rows that share a doc_id are predicted one by one; of languages with equal code lengths, the
first in alphabetical order wins. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachyline.llm.common import held, in_arrow, mapped, release

DEPTH = 4
DOCS_A_LANGUAGE = 400
MOST_LANGUAGES = 64
MOST_GRAMS = 400_000
#: Contexts times languages: what a task's table of code lengths may hold.
MOST_CELLS = 24_000
UNIT = 1024
BYTES_AT_ONCE = 1 << 18
#: Contexts whose code lengths are worked out at once.
NODES_AT_ONCE = 512
UNDETERMINED = "und"

_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """How often each run of depth + 1 bytes, as an integer, occurs in each language's sample."""

    languages: tuple[str, ...]
    depth: int
    grams: np.ndarray
    language: np.ndarray
    counts: np.ndarray


def train(labelled: DataFrame, depth: int = DEPTH, docs_a_language: int = DOCS_A_LANGUAGE,
          most_languages: int = MOST_LANGUAGES) -> Model:
    """Learn from rows of (text, lang); rows without either are left out."""
    rows = labelled.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    languages = tuple(sorted(row["lang"] for row in sizes))
    if not languages:
        nothing = np.empty(0, np.int64)
        return Model((), depth, nothing, nothing, nothing)
    rate = F.create_map(*(F.lit(x) for row in sizes for x in (row["lang"], docs_a_language / row["count"])))
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.filter(F.col("lang").isin(*languages) & (draw < rate[F.col("lang")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(b"\n" * depth + text.translate(_SMALL), np.uint8).astype(np.int64)
                grams = np.zeros(len(data) - depth, np.int64)
                for k in range(depth + 1):
                    grams = grams << 8 | data[k : k + len(grams)]
                found, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    counted = sample.select(F.col("text").cast("binary"), "lang").transform(in_arrow, count, "lang string, gram long, n long")
    top = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang", "gram").limit(MOST_GRAMS)
    found = top.toPandas()
    number = {name: i for i, name in enumerate(languages)}
    return Model(
        languages, depth, found["gram"].to_numpy(np.int64),
        found["lang"].map(number).to_numpy(np.int64), found["n"].to_numpy(np.int64),
    )


class ContextTrees:
    """The model worked out: contexts found by their bytes from last to first, code lengths by context and byte."""

    def __init__(self, model: Model):
        depth, width = model.depth, len(model.languages)
        self.depth = depth
        keys, totals, orders = [np.zeros(1, np.int64)], [np.array([model.counts.sum()])], [np.zeros(1, np.int64)]
        contexts = model.grams >> 8
        for order in range(1, depth + 1):
            found, place = np.unique(contexts & ((1 << 8 * order) - 1), return_inverse=True)
            keys.append(found)
            totals.append(np.bincount(place, model.counts).astype(np.int64))
            orders.append(np.full(len(found), order))
        key, total, order = map(np.concatenate, (keys, totals, orders))
        chosen = np.lexsort((key, order, -total))[: max(257, MOST_CELLS // width)]
        chosen = chosen[np.lexsort((key[chosen], order[chosen]))]
        key, order = key[chosen], order[chosen]
        nodes = len(key)
        self.dead = nodes
        self.child = np.full((nodes + 1, 256), nodes, np.int32)
        counts = np.zeros((nodes, 256, width))
        starts = np.searchsorted(order, np.arange(depth + 2))
        symbol = model.grams & 255
        parent = np.zeros(nodes, np.int64)
        for k in range(depth + 1):
            low, high = starts[k], starts[k + 1]
            here = contexts & ((1 << 8 * k) - 1)
            at = low + np.searchsorted(key[low:high], here)
            at[at == high] = low
            known = (key[at] == here) if high > low else np.zeros(len(here), bool)
            np.add.at(counts, (at[known], symbol[known], model.language[known]), model.counts[known])
            if k and high > low:
                suffix = key[low:high] & ((1 << 8 * (k - 1)) - 1)
                parent[low:high] = starts[k - 1] + np.searchsorted(key[starts[k - 1] : starts[k]], suffix)
                self.child[parent[low:high], key[low:high] >> 8 * (k - 1)] = np.arange(low, high)
        chance = np.empty((nodes, 256, width))
        for k in range(depth + 1):
            for low in range(starts[k], starts[k + 1], NODES_AT_ONCE):
                level = slice(low, min(low + NODES_AT_ONCE, starts[k + 1]))
                seen, above = counts[level], chance[parent[level]] if k else np.full((1, 256, width), 1 / 256)
                n, q = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
                rest = np.where(seen > 0, 0, above)
                left = rest.sum(1, keepdims=True)
                escape = np.where(left > 0, q, 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    chance[level] = np.where(
                        n == 0, above, np.where(seen > 0, seen / (n + escape), escape / (n + escape) * rest / left)
                    )
        del counts
        np.log2(chance, out=chance)
        chance *= -UNIT
        np.round(chance, out=chance)
        self.code = chance.astype(np.int32).reshape(nodes * 256, width)
        self.child = self.child.reshape(-1)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of each text under each language, in 1/1024 bits."""
        pad = b"\n" * self.depth
        data = np.frombuffer(pad + pad.join([text.translate(_SMALL) for text in texts]), np.uint8)
        lengths = np.array([len(text) for text in texts], np.int64)
        ends = np.cumsum(lengths + self.depth)
        out = np.zeros((len(texts), self.code.shape[1]), np.int64)
        for low in range(self.depth, len(data), BYTES_AT_ONCE):
            high = min(low + BYTES_AT_ONCE, len(data))
            best = np.zeros(high - low, np.int32)
            node = best
            for k in range(1, self.depth + 1):
                node = self.child[node * 256 + data[low - k : high - k]]
                best = np.where(node == self.dead, best, node)
            codes = self.code[best * 256 + data[low:high]]
            first, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right")
            starts = np.maximum(ends[first : last + 1] - lengths[first : last + 1], low)
            stops = np.minimum(ends[first : last + 1], high)
            sums = np.vstack([np.zeros((1, codes.shape[1]), np.int64), np.cumsum(codes, axis=0, dtype=np.int64)])
            stops = np.maximum(stops, starts)
            out[first : last + 1] += sums[np.minimum(stops, high) - low] - sums[np.minimum(starts, high) - low]
        return out


def _trees(model: Model) -> ContextTrees:
    """One worked-out model a Python worker: tasks that follow each other share it."""
    mark = hash((model.languages, model.depth, model.grams.tobytes(), model.language.tobytes(), model.counts.tobytes()))
    return held(("trees", mark), lambda: ContextTrees(model))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of each document as ``row``, with ``lang_pred`` and ``score``."""

    def worker():
        trees = _trees(model) if model.languages else None

        def work(texts):
            texts = texts.to_pylist()
            chosen = [i for i, text in enumerate(texts) if trees and text is not None and _LETTER.search(text)]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if chosen:
                bits = trees.code_lengths([texts[i].encode("utf-8", "surrogatepass") for i in chosen]) / UNIT
                best = bits.argmin(1)
                weight = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                for i, language, total in zip(chosen, best.tolist(), weight.tolist()):
                    names[i], scores[i] = model.languages[language], 1 / total
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return mapped(docs, keep or docs.columns, [F.col("text")], "lang_pred string, score double", worker)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training; one without an id is not, and isn't learned from either."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang")


def identified(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    found = predict(docs, train(training_rows(docs)), ["doc_id"])
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def documents_in_a_language(docs: DataFrame) -> DataFrame:
    """The documents for which a language is found, with their own columns.

    Where no document is labelled there is nothing to tell languages by: all with a letter stay.
    """
    model = train(training_rows(docs))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = predict(docs, model)
    return found.filter(F.col("lang_pred") != UNDETERMINED).select("row.*")
