"""Fuzzy line deduplication: one occurrence of each group of similar lines stays.

A line is normalised to its words: runs of letters and digits in small letters (ASCII capitals), which
leaves out punctuation and spacing; in scripts without spaces each character is a word. Lines of MIN_WORDS
words or more, that is with any, take part. Lines with the same words are one class. A pair of classes links if its word
sequences have an edit similarity, 1 - distance / longer length, of SIMILARITY or more and they are candidates.

Candidates come from SimHashes of LANES * 64 bits: each bit is the majority of that bit over the hashes of a line's
words, the second of equal words being another one. The bits are cut into BLOCKS blocks of 16. Two lines meet if a block is the same, the pigeonhole of SimHash
(lines that differ in fewer bits than there are blocks always share one), if their lengths allow SIMILARITY, and
if CHECKED of their bits differ in MOST_BITS places at most. So identical words always link, and
of linked lines the share that meets falls with their similarity: REACH is where it is RECALL or more whatever the
length (tests measure it against all pairs). Below, pairs that meet link all the same, down to SIMILARITY; at 0.9
about nine in ten do. A word-level similarity of 0.8 in whole is out of reach for SimHash blocks.

Linked classes form groups, and of all lines of a group the first stays: the one with the smallest
(doc_id, line number), documents without an id last. The lines of copies go like any others.
The other lines are cut out of their documents with their line breaks. That holds for short lines too:
a one-word line stays once in the whole table, unless ``min_words`` asks for more.

Null texts stay null; texts without taking lines stay as they are. Rows with the same doc_id and
text are one document: what is cut from one is cut from all. Rows that share a doc_id but
not the text come in the order of a hash of the text. Other columns are ignored. An empty table
gives no rows. Lines that meet in a bucket form clusters of chains, one row a line, which are then compared
by edit distance, where lines that have joined a group are skipped. A line goes to its BLOCKS buckets without its
key, many lines in a row: the CHECKED bits are all that is known of it there, and by them its key is found again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tachyline.llm.batches import whole_runs
from tachyline.llm.common import in_arrow, release, stored
from tachyline.llm.components import Sets, components
from tachyline.llm.hashing import ALPHANUMERIC, Words, by_bytes, mixed, run_hashes, words_of
from tachyline.llm.key_filter import KeyFilter

#: Lines of one to three words have only exact repeats: an edit is too much for SIMILARITY.
MIN_WORDS = 1
SIMILARITY = 0.8
#: The shortest line that may be linked to one a word longer.
MIN_FUZZY = 4
REACH, RECALL = 0.95, 0.9
#: Bits of a SimHash: words of 64, in blocks of 16; the last CHECKED bits go along with each block.
LANES = 6
BLOCKS = 4 * LANES
CHECKED, MOST_BITS = 128, 30
#: Longer lines count as so long where lengths are compared.
LONGEST = (1 << 20) - 1
#: Buckets in which a line meets more others than this are searched line by line.
WIDE = 1024
#: Classes whose postings are packed at once, and those of one block that go to a range of buckets.
PACKED, IN_RANGE = 1 << 18, 1 << 16
MOST_IN_TASK = 4096
#: A class with one of so many lines or more is not dealt by its key.
HOT_SHARE = 10_000

_RIGHT, _AGAIN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def allowed(n):
    """Edits by which linked lines may differ whose longer one has n words."""
    return np.floor(n - SIMILARITY * n + 1e-9).astype(np.int64)


def line_words(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of several texts, and of each line: its text, number, first word and end."""
    words = words_of(texts, ALPHANUMERIC, apart=True)
    breaks = np.flatnonzero(words.data == 10)
    firsts = words.offsets[:-1]
    starts = np.sort(np.concatenate([firsts, breaks + 1]), kind="stable")
    text = np.searchsorted(firsts, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, firsts)[text]
    first = np.searchsorted(words.starts, starts)
    last = np.concatenate([first[1:], [len(words.starts)]])
    return words, text, number, first, last


def simhashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """LANES words of 64 bits per run of words, of which none is empty: bits set in more than half of its words."""
    length = last - first
    # The second of equal words in a line is another feature: an edit changes one of them.
    line = np.repeat(np.arange(len(first)), length)
    at = np.arange(len(line)) + np.repeat(first - (np.cumsum(length) - length), length)
    own = hashes[at] + line.astype(np.uint64) * _RIGHT
    by_word = np.argsort(own)
    new = np.ones(len(own), bool)
    new[1:] = own[by_word[1:]] != own[by_word[:-1]]
    rank = np.empty(len(own), np.uint64)
    rank[by_word] = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    if not len(first):
        return np.empty((0, LANES), np.uint64)
    seeds = mixed(np.arange(1, LANES + 1, dtype=np.uint64)) | np.uint64(1)
    # A line's words fill up with empty ones to a multiple of 16, so that four levels of the tree need no indices.
    left = (length + 15) // 16
    places = np.arange(len(line)) + np.repeat(16 * (np.cumsum(left) - left) - (np.cumsum(length) - length), length)
    filled = np.zeros((16, int(left.sum())), np.uint64)
    filled[places & 15, places >> 4] = hashes[at] + rank * _AGAIN
    counted = []
    for seed in seeds:  # lane by lane, which stays in the processor's cache
        features = filled * seed
        features ^= features >> np.uint64(32)
        sums = [features]
        for rows in (8, 4, 2, 1):
            sums = added([plane[:rows] for plane in sums], [plane[rows:] for plane in sums])
        counted.append(sums)
    planes = [np.concatenate(plane) for plane in zip(*counted)]
    while left.max() > 1:
        some = (left + 1) // 2
        begin = np.repeat(np.cumsum(left) - left, some) + 2 * (np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some))
        paired = (begin + 1 < np.repeat(np.cumsum(left), some)).astype(np.uint64)
        second = np.minimum(begin + 1, planes[0].shape[1] - 1)
        planes = added([plane.take(begin, 1) for plane in planes], [plane.take(second, 1) * paired for plane in planes])
        left = some
    # Counts above half of the length, compared from the highest plane down.
    half, above = (length // 2).astype(np.uint64), np.zeros((LANES, len(first)), np.uint64)
    equal = ~above
    for number in range(len(planes) - 1, -1, -1):
        bit = np.uint64(0) - ((half >> np.uint64(number)) & np.uint64(1))
        above |= equal & planes[number] & ~bit
        equal &= ~(planes[number] ^ bit)
    return np.ascontiguousarray(above.T)


def added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of 64 numbers at once: the arrays of a list hold bit 0, 1, ... of each."""
    out, carry = [a[0] ^ b[0]], a[0] & b[0]
    for x, y in zip(a[1:], b[1:]):
        either = x ^ y
        out.append(either ^ carry)
        carry = (x & y) | (either & carry)
    return [*out, carry]


def text_key(text):
    return F.xxhash64(text, F.lit("text"))


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, line, key) of each line that takes part; ``n`` and the SimHash's lanes once a class and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        for batch in batches:
            texts = [text or b"" for text in batch.column(2).to_pylist()]
            for low, high in by_bytes(texts):
                words, text, number, first, last = line_words(texts[low:high])
                taking = last - first >= min_words
                text, number, first, last = text[taking], number[taking], first[taking], last[taking]
                keys = run_hashes(words.hashes, first, last).view(np.int64)
                fresh = np.zeros(len(keys), bool)
                fresh[np.unique(keys, return_index=True)[1]] = True
                fresh[fresh] = [key not in seen for key in keys[fresh].tolist()]
                seen.update(keys[fresh].tolist())
                bits = np.zeros((len(keys), LANES), np.uint64)
                hashed = fresh & (last - first >= MIN_FUZZY)
                bits[hashed] = simhashes(words.hashes, first[hashed], last[hashed])
                place = pa.array(text + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(place), batch.column(1).take(place), pa.array(number.astype(np.int64)),
                        pa.array(keys), pa.array(last - first, mask=~fresh),
                        *[pa.array(lane, mask=~fresh) for lane in bits.view(np.int64).T],
                    ],
                    names=["doc_id", "text_key", "line", "key", "n", *lanes],
                )

    lanes = [f"lane{lane}" for lane in range(LANES)]
    schema = "doc_id long, text_key long, line long, key long, n long, " + ", ".join(f"{lane} long" for lane in lanes)
    return docs.select(
        F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary")
    ).transform(in_arrow, work, schema)


def postings(classes: DataFrame) -> DataFrame:
    """(range, bits, low, high, first, second): postings of many classes in one row, for each block and range of buckets.

    A range is the number of its first bucket: the block and the first of its bits. ``bits``, the length's ``low`` 8
    bits and its ``high`` ones and the two words that are CHECKED hold a number a class, packed, by bucket and length.
    """

    def packed(n: np.ndarray, lanes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for number in range(BLOCKS):
            bits = (lanes[:, number // 4] >> np.uint64(16 * (number % 4))).astype(np.uint16)
            order = np.argsort((bits.astype(np.uint64) << np.uint64(20)) + n)
            bits, length = bits[order], n[order]
            ranges = bits & np.uint16(0x10000 - wide)
            starts = np.concatenate([[0], np.flatnonzero(ranges[1:] != ranges[:-1]) + 1])
            ends = np.append(starts, len(bits)).astype(np.int32)
            columns = [bits, length.astype(np.uint8), (length >> np.uint64(8)).astype(np.uint16), *lanes[order, -2:].T]
            yield pa.RecordBatch.from_arrays(
                [pa.array((number << 16) + ranges[starts].astype(np.int32))]
                + [
                    pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * c.itemsize), pa.py_buffer(c.tobytes())])
                    for c in columns
                ],
                names=["range", "bits", "low", "high", "first", "second"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(np.stack([column.to_numpy() for column in batch.columns], 1).view(np.uint64))
            rows += batch.num_rows
            if rows >= PACKED:
                some, held, rows = np.concatenate(held), [], 0
                yield from packed(some[:, 0], some[:, 1:])
        if rows:
            some = np.concatenate(held)
            yield from packed(some[:, 0], some[:, 1:])

    fuzzy = classes.filter(F.col("n") >= MIN_FUZZY)
    # Buckets of a range: a power of two, so that a block's classes are cut into ranges of IN_RANGE or fewer.
    wide = 1 << max(0, 16 - (fuzzy.count() // IN_RANGE).bit_length())
    # Fixed-width values alone: one row a class, which several tasks may have seen, by hashing.
    lanes = [F.first(f"lane{lane}").alias(f"lane{lane}") for lane in range(LANES)]
    lines = fuzzy.groupBy("key").agg(F.first("n").alias("n"), *lanes).drop("key")
    lines = lines.withColumn("n", F.least(F.col("n"), F.lit(LONGEST)))
    schema = "range int, bits binary, low binary, high binary, first binary, second binary"
    return lines.transform(in_arrow, work, schema)


def candidates(rows: DataFrame) -> DataFrame:
    """(label, first, second): CHECKED bits of lines that a chain of meetings in one bucket ties together.

    The label is a hash of all that are tied, so that what several blocks tie is one.
    The buckets of a range that comes in several parts are handed on whole, each under its number.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(range, place, first, second) of each posting; the place is its bucket and length in one number."""
        for batch in batches:
            counts = pc.binary_length(batch.column("low")).to_numpy()
            bits, low, high, first, second = (
                np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
                for name, kind in (("bits", "u2"), ("low", "u1"), ("high", "u2"), ("first", "i8"), ("second", "i8"))
            )
            ranges = np.repeat(batch.column("range").to_numpy(), counts).astype(np.int64)
            place = ((ranges >> 16 << 16) + bits << 20) + (high.astype(np.int64) << 8) + low
            columns = [pa.array(column) for column in (ranges, place, first, second)]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "place", "first", "second"])

    def near(x, others, first, second) -> np.ndarray:
        apart = np.bitwise_count(first[others] ^ first[x]) + np.bitwise_count(second[others] ^ second[x])
        return apart <= MOST_BITS

    def roots_of(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
        """The smallest index each is tied to by the pairs (a, b)."""
        roots = np.arange(count)
        while len(a):
            least = np.minimum(roots[a], roots[b])
            np.minimum.at(roots, roots[a], least)
            np.minimum.at(roots, roots[b], least)
            roots = roots[roots]
            open_ = roots[a] != roots[b]
            a, b = a[open_], b[open_]
        while (roots[roots] != roots).any():
            roots = roots[roots]
        return roots

    def tied(low: int, high: int, last: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ties of one bucket in which lines meet many others: what is tied needn't be met again."""
        out, left, backward = [], np.arange(low, high), np.searchsorted(last[low:high], np.arange(low, high), "right") + low
        while len(left):
            start, left = left[0], left[1:]
            front = [int(start)]
            while front and len(left):
                x = front.pop()
                begin, end = np.searchsorted(left, (backward[x - low], last[x]))
                some = left[begin:end]
                found = np.flatnonzero(near(x, some, first, second))
                if len(found):
                    out.append((np.full(len(found), start), some[found]))
                    front += some[found].tolist()
                    left = np.delete(left, begin + found)
        return out

    def meetings(bucket, n, first, second) -> tuple[np.ndarray, np.ndarray]:
        count = len(bucket)
        at = (bucket - bucket[0]) * (2 * LONGEST) + n
        last = np.searchsorted(at, (bucket - bucket[0]) * (2 * LONGEST) + np.minimum((n / SIMILARITY + 1e-9).astype(np.int64), 2 * LONGEST - 1), "right")
        window = last - np.arange(count) - 1
        pairs = []
        ends = np.concatenate([np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [count]])
        starts = np.concatenate([[0], ends[:-1]])
        for low, high in zip(starts.tolist(), ends.tolist()) if window.max(initial=0) > WIDE else ():
            if window[low:high].max() > WIDE:
                pairs += tied(low, high, last, first, second)
                window[low:high] = 0
        rows = np.flatnonzero(window > 0)
        step = 1
        while len(rows):
            if 4 * len(rows) > count:  # most lines: without gathering them
                close = near(slice(step, None), slice(None, -step), first, second)
                hit = np.flatnonzero(close & (window[:-step] >= step))
            else:
                hit = rows[near(rows, rows + step, first, second)]
            if len(hit):
                pairs.append((hit, hit + step))
            step += 1
            rows = rows[window[rows] >= step]
        none = np.empty(0, np.int64)
        return tuple(np.concatenate([none, *each]) for each in (zip(*pairs) if pairs else ((), ())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part, continued, goes_on in whole_runs(opened(batches), 1):
            ranges, place, first, second = (part.column(c).combine_chunks().to_numpy() for c in range(4))
            parted = np.zeros(len(ranges), bool)
            for partial, run in ((continued, ranges[0]), (goes_on, ranges[-1])):
                if partial:
                    parted |= ranges == run
            found = [(place[parted] >> 20, first[parted], second[parted])]
            whole = np.flatnonzero(~parted)
            whole = whole[np.argsort(place[whole])]
            if len(whole):
                place, first, second = place[whole], first[whole], second[whole]
                a, b = meetings(place >> 20, place & LONGEST, first.view(np.uint64), second.view(np.uint64))
                roots = roots_of(a, b, len(whole))
                some = np.flatnonzero(np.bincount(roots, minlength=len(whole))[roots] > 1)
                label = np.zeros(len(whole), np.uint64)
                np.add.at(label, roots[some], mixed(mixed(first[some].view(np.uint64)) ^ second[some].view(np.uint64)))
                found.append((label[roots[some]].view(np.int64), first[some], second[some]))
            columns = [np.concatenate(each) for each in zip(*found)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["label", "first", "second"])

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(count, "range")
        .sortWithinPartitions("range")
        .transform(in_arrow, work, "label long, first long, second long")
        .distinct()
    )


def clusters(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(label, key): the classes of the CHECKED bits that are tied, under the smallest key of them."""
    checked = [F.col(f"lane{LANES - 2}").alias("first"), F.col(f"lane{LANES - 1}").alias("second")]
    fuzzy = classes.filter(F.col("n") >= MIN_FUZZY).select("key", *checked)
    tied = stored(fuzzy.join(found, ["first", "second"]).select("label", "key"), "line-meetings")
    least = tied.groupBy("label").agg(F.min("key").alias("least"))
    return tied.join(least, "label").select(F.col("least").alias("label"), "key").distinct()


def blocked(tied: DataFrame) -> DataFrame:
    """(label, i, j, key): clusters of more than MOST_IN_TASK classes are compared block by block."""
    large = tied.groupBy("label").count().filter(F.col("count") > MOST_IN_TASK)
    large = large.select("label", F.ceil(2 * F.col("count") / MOST_IN_TASK).cast("int").alias("_blocks"))
    rows = tied.join(large, "label", "left")
    own = F.coalesce(F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"), F.lit(0))
    others = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(others))
    return rows.select("label", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "key")


def wanted_lines(docs: DataFrame, wanted: KeyFilter, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, words): the words' hashes of wanted classes, once a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = [text or b"" for text in batch.column(0).to_pylist()]
            rows = []
            for low, high in by_bytes(texts):
                words, _, _, first, last = line_words(texts[low:high])
                taking = last - first >= min_words
                first, last = first[taking], last[taking]
                keys = run_hashes(words.hashes, first, last).view(np.int64)
                for at in np.flatnonzero(wanted.passing(keys)).tolist():
                    key = int(keys[at])
                    if key not in seen:
                        seen.add(key)
                        rows.append((key, words.hashes[first[at] : last[at]].tobytes()))
            if rows:
                keys, values = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], names=["key", "words"])

    return docs.select(F.col("text").cast("binary")).transform(in_arrow, work, "key long, words binary")


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, by bit vectors over the first one."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return len(a) + len(b)
    mask, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    places: dict = {}
    for i, item in enumerate(a):
        places[item] = places.get(item, 0) | 1 << i
    up, down, score = mask, 0, len(a)
    for item in b:
        equal = places.get(item, 0)
        across = (((equal & up) + up) ^ up) | equal
        more, less = (down | ~(across | up)) & mask, up & across
        score += bool(more & high) - bool(less & high)
        more, less = (more << 1 | 1) & mask, less << 1 & mask
        equal |= down
        up, down = (less | ~(equal | more)) & mask, more & equal
    return score


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the edit similarity is reached; word by word differences from both ends bound the distance from above."""
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    allowed = int(longer - SIMILARITY * longer + 1e-9)
    if longer - shorter > allowed:
        return False
    left, right = np.zeros(shorter + 1, np.int64), np.zeros(shorter + 1, np.int64)
    np.cumsum(a[:shorter] != b[:shorter], out=left[1:])
    if longer - shorter + left[-1] <= allowed:
        return True
    np.cumsum(a[len(a) - shorter :][::-1] != b[len(b) - shorter :][::-1], out=right[1:])
    # Up to a word from the left, the others from the right.
    if longer - shorter + (left + right[::-1]).min() <= allowed:
        return True
    first, last = np.searchsorted(left, 0, "right") - 1, np.searchsorted(right, 0, "right") - 1
    last = min(last, shorter - first)
    a, b = a[first : len(a) - last].tolist(), b[first : len(b) - last].tolist()
    # Each word that the other line lacks takes an edit.
    if max(len(set(a).difference(b)), len(set(b).difference(a))) > allowed:
        return False
    return edit_distance(a, b) <= allowed


def sketches(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """256 bits in which every word flips one: d edits change 2 d bits at most, so no link is lost by them."""
    lane = (hashes >> np.uint64(6)) & np.uint64(3)
    out = np.empty((len(first), 4), np.uint64)
    for number in range(4):
        flips = np.zeros(len(hashes) + 1, np.uint64)
        one = (lane == number).astype(np.uint64) << (hashes & np.uint64(63))
        np.bitwise_xor.accumulate(one, out=flips[1:])
        out[:, number] = flips[last] ^ flips[first]
    return out


def links(clustered: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b): for each class that links to others of its cluster, a link to one of its group."""

    def of_cluster(keys: list[int], lines: list[np.ndarray], n: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
        groups, label = Sets(len(keys)), np.arange(len(keys))
        for x in range(len(keys) - 1):
            others = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
            bits = np.bitwise_count(sketch[others] ^ sketch[x]).sum(1)
            others = others[bits <= 2 * allowed(np.maximum(n[others], n[x]))]
            for y in others.tolist():
                if label[y] != label[x] and similar(lines[x], lines[y]):
                    label[label == label[y]] = label[x]
                    groups.join(x, y)
        return [(keys[i], keys[root]) for i, root in enumerate(groups.roots()) if i != root]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in whole_runs(batches, 3, most_held=1 << 30):
            label, i, j, key = (rows.column(c).combine_chunks().to_numpy() for c in range(4))
            new = np.concatenate([[True], (label[1:] != label[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            starts = [*np.flatnonzero(new).tolist(), len(key)]
            out: list[tuple[int, int]] = []
            lines = [np.frombuffer(line, np.uint64) for line in rows.column(4).to_pylist()]
            n = np.array([len(line) for line in lines])
            sketch = sketches(np.concatenate(lines), np.cumsum(n) - n, np.cumsum(n))
            for a, b in zip(starts, starts[1:]):
                if b - a > 1:
                    out += of_cluster(key[a:b].tolist(), lines[a:b], n[a:b], sketch[a:b])
            if out:
                first, second = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    count = int(clustered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        clustered.join(words.dropDuplicates(["key"]), "key")
        .select("label", "i", "j", "key", "words")
        .repartition(count, "label", "i", "j")
        .sortWithinPartitions("label", "i", "j", "key")
        .transform(in_arrow, work, "a long, b long")
    )


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, lines): the lines of each document that aren't the first of their group."""
    lines = stored(occurrences(docs, min_words), "lines")
    classes = lines.filter(F.col("n").isNotNull())
    found = clusters(candidates(postings(classes)), classes)
    clustered = stored(blocked(stored(found, "line-candidates")), "line-clusters")
    words = wanted_lines(docs, KeyFilter(clustered, "key"), min_words)
    roots = stored(components(links(clustered, words)), "line-roots")
    # Firsts and counts per class before anything is joined: a common line is one row from here on.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line")
    firsts = lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    rooted = firsts.join(roots, firsts["key"] == roots["node"], "left").withColumn("root", F.coalesce("root", "key"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("all")).filter(F.col("all") > 1)
    cut = stored(rooted.select("root", "key", "n").join(groups, "root").select("key", "n", "first"), "line-firsts")
    total = lines.count()
    hot = F.col("n") * HOT_SHARE >= total  # HOT_SHARE classes at most
    every = lines.select("key", place.alias("place"))
    common = every.join(F.broadcast(cut.filter(hot).drop("n")), "key", "left")
    others = common.filter(F.col("first").isNull()).drop("first").join(cut.filter(~hot).drop("n"), "key")
    found = common.filter(F.col("first").isNotNull()).unionByName(others).filter(F.col("place") != F.col("first"))
    return found.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.text_key").alias("text_key")).agg(
        F.collect_set("place.line").alias("lines")
    )


def without_repeats(docs: DataFrame, keep: list[str] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """The kept columns of each document as ``row``, the new text, lines before and lines cut."""
    keep = keep or docs.columns
    cut = stored(repeats(docs, min_words), "cut-lines")
    touched = KeyFilter(cut, "text_key")

    @F.arrow_udf("boolean")
    def maybe(keys: pa.Array) -> pa.Array:  # sees the keys alone; texts stay where they are
        return pa.array(touched.passing(keys.fill_null(0).to_numpy(zero_copy_only=False)))

    id_and_key = [F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_key")]
    apart = [] if "text" in keep else ["text"]
    named = docs.select(F.struct(*keep).alias("row"), *id_and_key, *apart)
    marked = named.withColumn("maybe", maybe("_key"))
    text = F.col("text" if apart else "row.text")
    lines = F.split(text, "\n", -1)
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    n_lines = F.coalesce((breaks + 1).cast("long"), F.lit(0).cast("long")).alias("n_lines")
    whole = marked.filter(~F.col("maybe")).select("row", text.alias("text"), n_lines, F.lit(0).cast("long").alias("n_cut"))
    joined = marked.filter("maybe").join(cut, (F.col("_key") == cut["text_key"]) & F.col("_id").eqNullSafe(cut["doc_id"]), "left")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("lines", i.cast("long"))), "\n")
    changed = joined.select(
        "row",
        F.when(F.col("lines").isNull(), text).otherwise(left).alias("text"),
        n_lines,
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_cut"),
    )
    return whole.unionByName(changed)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per document: what is left of its text, its lines, and how many were cut."""
    return without_repeats(docs, ["doc_id"], min_words).select("row.doc_id", "text", "n_lines", "n_cut")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, the texts without repeated lines and n_chars to fit.

    A document all of whose words were in lines that are cut is left out.
    """
    found = without_repeats(docs)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    found = found.filter((F.col("n_cut") == 0) | has_words)
    columns = []
    for field in docs.schema.fields:
        value = F.col("row")[field.name]
        if field.name == "text":
            value = F.col("text")
        elif field.name == "n_chars" and isinstance(field.dataType, T.IntegralType):
            value = F.when(F.col("n_cut") > 0, F.length("text").cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return found.select(*columns)
