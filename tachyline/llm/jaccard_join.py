"""Exact Jaccard self-join of documents' shingle sets, and the groups that its links form.

Documents with the same set are one class, known by a 64-bit fingerprint of the set. The classes
are joined through an inverted index on their prefixes: in a common order of all shingles, rare
ones first, two sets that link share one of each set's first n - ceil(t n) + 1 shingles. Frequent
shingles, those in one of FREQUENT classes or more as far as counting by blocks of documents
shows, come last; any order gives right results, this one keeps the lists short.

Set relations are used twice to skip work.

* Index lists are kept by size and position. Two sets that share the shingle at positions i and j
  overlap in at most min(i, j) + 1 + what follows in the smaller rest; where sizes or
  positions rule a link out, the pair or the whole block of a list is skipped. In short lists the
  pairs that are left are counted over all lists: a pair needs a number of common prefix
  shingles that follows from the sizes. A long list is the mark of many highly similar sets; it
  isn't expanded, its members go to one cluster.
* In a cluster, a set that links to one whose group is known joins that group and is
  compared with none of the group's other members. Comparisons take the rest, by bitmaps of the sets
  first and exactly then. So a group of n near copies costs about n comparisons, and gives n - 1
  links, not n^2. Clusters beyond MOST_IN_TASK sets are compared in blocks.

Links are joined to components by stars. A link between different sets is never lost.

Words are separated by white space, ASCII capitals count as small letters. A text with fewer
words than a shingle is a shingle as a whole. Null texts and texts without words have an empty
set, no link, and their own id as component. A component's id is its smallest non-null doc_id;
documents with equal sets are in one component, rows that share a doc_id but no link are not.
Other columns are ignored; an empty table gives no rows. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tachyline.llm.batches import whole_runs
from tachyline.llm.common import in_arrow, mapped, stored
from tachyline.llm.components import Sets, components
from tachyline.llm.hashing import SMALL, by_bytes, mixed, words_of
from tachyline.llm.key_filter import KeyFilter

SHINGLE = 4
PERCENT = 85
#: A shingle in more than one of so many classes is frequent.
FREQUENT = 2000
SHINGLES_A_BLOCK = 2_000_000
SHORT_LIST = 16
BLOCK = 512
MOST_IN_TASK = 4096
SKETCH_BITS = 1024

_PLACES = np.random.default_rng(715).integers(0, 1 << 62, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FINGERPRINT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Rule:
    """Two sets link if 100 * intersection >= percent * union."""

    width: int = SHINGLE
    percent: int = PERCENT

    def overlap(self, n, m):
        """The least intersection of linked sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def prefix(self, n):
        return n - -(-self.percent * n // 100) + 1


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, ascending."""
    texts = [text or b"" for text in texts]
    for first, last in by_bytes(texts):
        words = words_of(texts[first:last], SMALL)
        count = len(words.hashes)
        sums = np.zeros(max(count - width + 1, 0), np.uint64)
        for k in range(width):
            sums += words.hashes[k : k + len(sums)] * _PLACES[k]
        grams = mixed(sums)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            if b - a >= width:
                held = np.sort(grams[a : b - width + 1])
                yield held[np.concatenate([[True], held[1:] != held[:-1]])]
            elif b > a:
                whole = (words.hashes[a:b] * _PLACES[: b - a]).sum(keepdims=True) + _PLACES[width + b - a]
                yield mixed(whole)
            else:
                yield np.empty(0, np.uint64)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit key of each set; of an empty set, 0."""
    sizes = np.array([len(each) for each in sets], np.int64)
    if not sizes.sum():
        return np.zeros(len(sets), np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(np.concatenate(sets) ^ _FINGERPRINT))])
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, mixed(sums[ends] - sums[ends - sizes]).view(np.int64), 0)


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``key`` of each document; and (token, count) of shingles that
    are in several sets of a block of documents. Both kinds of rows come from one pass."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "doc_id", "n", "key"]
        block: dict[int, np.ndarray] = {}
        held = 0

        def repeated() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(list(block.values())), return_counts=True)
            some = counts > 1
            tokens = pa.array(found[some].view(np.int64))
            empty = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([tokens, empty, pa.array(counts[some].astype(np.int64)), empty], names=names)

        for batch in batches:
            sets = list(shingle_sets(batch.column(1).to_pylist(), rule.width))
            keys = fingerprints(sets)
            sizes = np.array([len(each) for each in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(sets), pa.int64()), batch.column(0), pa.array(sizes), pa.array(keys, mask=sizes == 0)], names=names
            )
            for key, each in zip(keys.tolist(), sets):
                if len(each) and key not in block:
                    block[key] = each
                    held += len(each)
            if held > SHINGLES_A_BLOCK:
                yield repeated()
                block, held = {}, 0
        if block:
            yield repeated()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).transform(
        in_arrow, sign, "token long, doc_id long, n long, key long"
    )


def frequent_shingles(counts: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, with their counts. There are at most FREQUENT times a mean set."""
    total = counts.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") * FREQUENT >= F.lit(classes)).toPandas()
    tokens, n = total["token"].to_numpy(np.int64).view(np.uint64), total["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


@dataclass(frozen=True)
class Order:
    """A common order of all shingles: others, common ones, frequent ones by count; ties by hash."""

    frequent: np.ndarray
    counts: np.ndarray
    common: KeyFilter | None = None

    def first(self, shingles: np.ndarray, length: int) -> np.ndarray:
        """The first ``length`` of a set's ascending shingles."""
        late = np.zeros(len(shingles), bool)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, shingles), len(self.frequent) - 1)
            late = self.frequent[at] == shingles
        known = self.common.passing(shingles.view(np.int64)) & ~late if self.common else np.zeros(len(shingles), bool)
        out = shingles[~late & ~known][:length]
        if len(out) < length:
            out = np.concatenate([out, shingles[known][: length - len(out)]])
        if len(out) < length:
            by_count = shingles[late][np.argsort(self.counts[at[late]], kind="stable")]
            out = np.concatenate([out, by_count[: length - len(out)]])
        return out


def prefixes(texts: list[bytes | None], rule: Rule, order: Order, seen: set[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, size, prefix) of each class not seen before."""
    sets = list(shingle_sets(texts, rule.width))
    for key, each in zip(fingerprints(sets).tolist(), sets):
        if len(each) and key not in seen:
            seen.add(key)
            yield key, len(each), order.first(each, rule.prefix(len(each)))


def common_shingles(docs: DataFrame, rule: Rule, order: Order) -> KeyFilter:
    """Shingles with more than SHORT_LIST entries in an index by this order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = [prefix for _, _, prefix in prefixes(batch.column(0).to_pylist(), rule, order, seen)]
            if found:
                tokens, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "n"]
                )

    counts = docs.select(F.col("text").cast("binary")).transform(in_arrow, count, "token long, n long")
    lists = counts.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > SHORT_LIST)
    return KeyFilter(lists, "token")


def prefix_postings(docs: DataFrame, rule: Rule, order: Order) -> DataFrame:
    """(token, place, key): size << 32 | position of each prefix shingle, once a class and task."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = list(prefixes(batch.column(0).to_pylist(), rule, order, seen))
            if found:
                lengths = [len(prefix) for _, _, prefix in found]
                place = np.concatenate([np.arange(length) + (n << 32) for (_, n, _), length in zip(found, lengths)])
                columns = [
                    np.concatenate([prefix for _, _, prefix in found]).view(np.int64),
                    place,
                    np.repeat([key for key, _, _ in found], lengths),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "place", "key"])

    return docs.select(F.col("text").cast("binary")).transform(in_arrow, post, "token long, place long, key long")


def possible(rule: Rule, n, i, m, j):
    """Whether sets of sizes n and m that share a shingle at positions i and j can link."""
    bound = np.minimum(i, j) + 1 + np.minimum(n - i, m - j) - 1
    return (100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m)) & (bound >= rule.overlap(n, m))


def candidates(postings: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, n, m) for a pair in a short list, (label, member, 0, 0) for members of a long one."""
    names = ["a", "b", "n", "m"]

    def pairs_of(key, n, place, starts, length) -> Iterator[list[np.ndarray]]:
        for x in range(length):
            for y in range(x + 1, length):
                a, b = starts + x, starts + y
                ok = possible(rule, n[a], place[a], n[b], place[b])
                a, b = a[ok], b[ok]
                swap = key[a] > key[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield [key[a], key[b], n[a], n[b]]

    def members_of(key, n, place) -> Iterator[np.ndarray]:
        """Those with a possible partner, by runs of sizes; blocks that can hold none are skipped."""
        gaps = np.flatnonzero(100 * n[:-1] < rule.percent * n[1:]) + 1
        for part in np.split(np.arange(len(key)), gaps):
            linked = np.zeros(len(part), bool)
            for low in range(0, len(part), BLOCK):
                x = part[low : low + BLOCK]
                for other in range(low, len(part), BLOCK):
                    y = part[other : other + BLOCK]
                    if 100 * n[x[-1]] < rule.percent * n[y[0]]:
                        break
                    ok = possible(rule, n[x][:, None], place[x][:, None], n[y][None, :], place[y][None, :])
                    if other == low:
                        np.fill_diagonal(ok, False)
                    linked[low : low + BLOCK] |= ok.any(1)
                    linked[other : other + BLOCK] |= ok.any(0)
                    if linked[low : low + BLOCK].all() and linked[other:].all():
                        break
            if linked.any():
                yield part[linked]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = None
        for rows, continued, goes_on in whole_runs(batches, 1):
            token, place, key = (rows.column(i).combine_chunks().to_numpy() for i in range(3))
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])
            token, place, key = token[new], place[new], key[new]
            n, place = place >> 32, place & 0xFFFFFFFF
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            lengths = np.diff(np.concatenate([starts, [len(token)]]))
            whole = np.ones(len(starts), bool)
            out: list[list[np.ndarray]] = []
            parted = ({0} if continued else set()) | ({len(starts) - 1} if goes_on else set())
            for run in sorted(parted):
                part = key[starts[run] : starts[run] + lengths[run]]
                label = label if continued and run == 0 else part.min()
                out.append([np.full(len(part), label), part, np.zeros(len(part), int), np.zeros(len(part), int)])
                whole[run] = False
            for length in range(2, SHORT_LIST + 1):
                out.extend(pairs_of(key, n, place, starts[whole & (lengths == length)], length))
            for run in np.flatnonzero(whole & (lengths > SHORT_LIST)):
                at = slice(starts[run], starts[run] + lengths[run])
                for members in members_of(key[at], n[at], place[at]):
                    part = key[at][members]
                    out.append([np.full(len(part), part.min()), part, np.zeros(len(part), int), np.zeros(len(part), int)])
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
            if columns and len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    count = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        postings.repartition(count, "token")
        .sortWithinPartitions("token", "place", "key")
        .transform(in_arrow, work, "a long, b long, n long, m long")
    )


def clusters(found: DataFrame, rule: Rule) -> DataFrame:
    """(label, i, j, key): sets to compare with one another. Pairs in short lists must share enough."""
    n, m = F.col("n"), F.col("m")
    total, percent = F.lit(100 + rule.percent), F.lit(rule.percent)
    overlap = F.ceil(percent * (n + m) / total)
    rest = F.greatest(F.ceil(percent * n / 100), F.ceil(percent * m / 100)) - 1
    pairs = found.filter(n > 0).groupBy("a", "b", "n", "m").count().filter(F.col("count") >= overlap - rest)
    rows = pairs.select(F.col("a").alias("label"), F.explode(F.array("a", "b")).alias("key")).unionByName(
        found.filter(n == 0).select(F.col("a").alias("label"), F.col("b").alias("key"))
    )
    rows = stored(rows.distinct(), "clusters")
    large = rows.groupBy("label").count().filter(F.col("count") > MOST_IN_TASK)
    large = large.select("label", F.ceil(2 * F.col("count") / MOST_IN_TASK).cast("int").alias("_blocks"))
    rows = rows.join(large, "label", "left")
    own = F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")
    other = F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("_other", other)
    return rows.select("label", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "key")


def sets_of(docs: DataFrame, rule: Rule, wanted: KeyFilter) -> DataFrame:
    """(key, shingles) of wanted classes: the hashes' upper 48 bits, ascending, 6 bytes each.

    Within a pair of sets of 1,000 shingles, two different ones agree in these bits once in 10^8 pairs.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets = list(shingle_sets(batch.column(0).to_pylist(), rule.width))
            keys = fingerprints(sets)
            rows = []
            for i in np.flatnonzero(wanted.passing(keys)).tolist():
                key = int(keys[i])
                if len(sets[i]) and key not in seen:
                    seen.add(key)
                    rows.append((key, sets[i].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            if rows:
                ids, values = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], names=["key", "shingles"])

    return docs.select(F.col("text").cast("binary")).transform(in_arrow, pick, "key long, shingles binary")


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def linked_roots(sets: list[np.ndarray], rule: Rule) -> list[int]:
    """For each set, the first set of its group in this list."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    groups = Sets(len(sets))
    label = np.arange(len(sets))
    sketches = None
    if len(sets) > 2:
        sketches = np.zeros((len(sets), SKETCH_BITS), np.uint8)
        for row, i in enumerate(order):
            sketches[row] = np.bincount((sets[i] & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
        sketches = np.packbits(sketches, axis=1).view(np.uint64)
    for x in range(len(order)):
        last = np.searchsorted(sizes * rule.percent, 100 * sizes[x], "right")
        others = np.arange(x + 1, last)
        others = others[label[others] != label[x]]
        if sketches is not None and len(others):
            apart = np.bitwise_count(sketches[others] ^ sketches[x]).sum(1)
            total = sizes[others] + sizes[x]
            others = others[(total - apart) // 2 >= rule.overlap(sizes[x], sizes[others])]
        for y in others.tolist():
            if label[y] == label[x]:
                continue
            a, b = sets[order[x]], sets[order[y]]
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= rule.percent * (len(a) + len(b) - common):
                label[label == label[y]] = label[x]
                groups.join(order[x], order[y])
    return groups.roots()


def links(clustered: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): for each set of a cluster that links to others, a link to one of its group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in whole_runs(batches, 3, most_held=1 << 30):
            label, i, j, key = (rows.column(c).combine_chunks().to_numpy() for c in range(4))
            data = rows.column(4)
            new = np.concatenate([[True], (label[1:] != label[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            starts = [*np.flatnonzero(new).tolist(), len(key)]
            out: list[tuple[int, int]] = []
            for a, b in zip(starts, starts[1:]):
                if b - a > 1:
                    sets_here = [unpacked(each) for each in data.slice(a, b - a).to_pylist()]
                    own = key[a:b].tolist()
                    roots = linked_roots(sets_here, rule)
                    out += [(own[k], own[root]) for k, root in enumerate(roots) if k != root]
            if out:
                first, second = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    count = int(clustered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        clustered.join(sets.dropDuplicates(["key"]), "key")
        .select("label", "i", "j", "key", "shingles")
        .repartition(count, "label", "i", "j")
        .sortWithinPartitions("label", "i", "j", "key")
        .transform(in_arrow, work, "a long, b long")
    )


def document_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """``doc_id``, ``n_shingles``, ``component_id``, and the keys of its class and component."""
    signed = stored(signatures(docs, rule), "signatures")
    members = signed.filter(F.col("token").isNull()).select("doc_id", F.col("n").alias("n_shingles"), "key")
    classes = members.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"))
    order = Order(*frequent_shingles(signed.filter(F.col("token").isNotNull()), classes.count()))
    order = replace(order, common=common_shingles(docs, rule, order))
    found = candidates(prefix_postings(docs, rule, order), rule)
    clustered = clusters(stored(found, "candidates"), rule)
    sets = sets_of(docs, rule, KeyFilter(clustered, "key"))
    roots = components(links(clustered, sets, rule))
    rooted = classes.join(roots, classes["key"] == roots["node"], "left").select(
        "key", "least", F.coalesce("root", "key").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("key", "root", "component_id")
    return members.join(named, "key", "left").select(
        "doc_id", "n_shingles", "key", "root",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """The documents, with their own columns, without those that link to one with a smaller doc_id.

    Documents without words are all kept. Of rows with the same set and doc_id, one is kept; in
    groups without any doc_id, one of the rows with the smallest key.
    """
    groups = stored(document_groups(docs, rule), "groups").filter(F.col("key").isNotNull())
    first = F.row_number().over(Window.partitionBy("root").orderBy("key"))
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("_first", first)
    kept = kept.filter(F.col("_first") == 1).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))

    def worker():
        def work(texts):
            return [pa.array(fingerprints(list(shingle_sets(texts.to_pylist(), rule.width))))]

        return work

    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = mapped(docs.filter(has_words), docs.columns, [F.col("text").cast("binary")], "key long", worker)
    matched = keyed.join(kept, (keyed["key"] == kept["_key"]) & F.col("row.doc_id").eqNullSafe(F.col("_id")))
    copies = Window.partitionBy("_id", "_key").orderBy("_id")
    once = matched.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") == 1)
    return once.select("row.*").unionByName(docs.filter(~has_words))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return document_groups(docs).select("doc_id", "n_shingles", "component_id")
