"""Quality rules by distribution divergence, in DataFrame functions alone.

Two histograms of each document are compared with those of its language by Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1): one over character classes, one over
the language's most common words and all others. A language's reference adds up the histograms of
all its documents with MIN_WORDS words or more; documents of other or no language are compared with
the reference over all languages together. References are counted over the whole table.

A document is kept if it passes the base rules, its character distance is at most MOST_CHARS and
its word distance at most MOST_WORDS plus WORD_NOISE over the root of its number of words: the
fewer words, the noisier their histogram. Short texts aren't judged by it: the first needs
MIN_CHARS code points, the second MIN_WORDS words, to count against a document; where there is
no reference, the distance is null and doesn't count either.

Null text has no words, fails the base rules and isn't kept; so does empty text. Rows that share a
doc_id are judged one by one. An empty table gives no rows. Common words are words of the text as
they stand, however long, and every language has its own; those of equal frequency are taken in
alphabetical order. Repeated windows are found by 64-bit hashes within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tachyline.llm.common import stored

MIN_CHARS = 200
MIN_WORDS = 50
MOST_CHARS = 0.28
MOST_WORDS = 0.2
WORD_NOISE = 1.3
COMMON_WORDS = 24
#: Bytes of a common word: no word is too long to be one.
LONGEST_COMMON = 2**31 - 1
#: Code points of a common word by which words are looked for first.
START = 16
ALL = "*"

SPACE = r"[\x20\x09-\x0D]+"
#: Small letters and white space: no class below holds any of them, and neither do the symbols of the base counts.
MOSTLY = r"[a-z\x20\x09-\x0D]+"
#: Character classes beside white space: capital letters, digits, marks, symbols, characters
#: beyond ASCII. What is left, mostly small letters, is the last class.
CLASSES = (
    r"[A-Z]+", r"[0-9]+", r"[.,;:!?'\"()-]+", r"[#$%&*+/<=>@\[\\\]^_`{|}~]+", r"[^\x00-\x7F]+",
)
#: What is left of a text without MOSTLY, then without each class in turn; the symbols are the fourth.
LEFT = tuple(f"left{i}" for i in range(len(CLASSES) + 1))


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _shorter(before: str, after: str | Column) -> Column:
    return (F.length(before) - F.length(after)).cast("long")


def words_of_text() -> Column:
    return F.array_remove(F.split("text", SPACE, -1), "")


def common_words(rows: DataFrame) -> DataFrame:
    """Language and its most common words with their counts, most common first; ALL for all."""
    rows = rows.filter(F.col("n_words") >= MIN_WORDS)
    words = stored(rows.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count(), "words")
    own = F.col("lang").isNotNull() & (F.col("lang") != ALL)
    in_all = words.groupBy("word").agg(F.sum("count").alias("count")).select(F.lit(ALL).alias("lang"), "word", "count")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = words.filter(own).unionByName(in_all).withColumn("rank", rank).filter(F.col("rank") <= COMMON_WORDS)
    common = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "count"))).alias("top"))
    return stored(common.select(F.col("lang").alias("ref"), "top"), "common")


def own_or_all(rows: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """The named columns of the row's language ``ref`` beside each row, those of ALL where it has none."""
    whole = found.filter(F.col("ref") == ALL).select(*[F.col(name).alias(f"all_{name}") for name in names])
    own = found.filter(F.col("ref") != ALL).select("ref", *names)
    # The first is a single row; of the second, Spark knows the size and broadcasts it if that is small.
    rows = rows.join(F.broadcast(whole), how="left").join(own, F.col("lang") == F.col("ref"), "left")
    return rows.withColumns({name: F.coalesce(name, f"all_{name}") for name in names}).drop(
        "ref", *[f"all_{name}" for name in names]
    )


def measured(docs: DataFrame, keep: list[str], common: DataFrame | None = None) -> DataFrame:
    """The kept columns as ``row``, ``lang``, the base counts, class counts and words.

    With the ``common`` words known, ``held`` counts them and takes the place of the words: all
    that is read from the texts, and small.
    """
    rows = docs.select(
        F.struct(*keep).alias("row"), F.col("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    if common is not None:
        starts = F.array_join(F.transform("top.word", lambda w: F.left(w, F.lit(START))), " ")
        found = common.select("ref", F.col("top.word").alias("common"), starts.alias("starts"))
        rows = own_or_all(rows, found, ["common", "starts"])
    kept = "words" if common is None else "held"
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n"),
            F.length(F.array_join(words, "")).cast("long").alias("chars"),
            _repeated_words(words).cast("long").alias("repeated"),
            (words if common is None else held_words(words)).alias(kept),
        )

    rows = rows.withColumn("counts", let(words_of_text(), of_words))
    # Every class is counted in what is left without the two that make up most of a text, and without those before it.
    rows = rows.withColumn(LEFT[0], F.regexp_replace("text", MOSTLY, ""))
    for before, after, pattern in zip(LEFT, LEFT[1:], CLASSES):
        rows = rows.withColumn(after, F.regexp_replace(before, pattern, ""))
    return rows.select(
        "row", "lang",
        F.col("counts.n").alias("n_words"),
        F.col("counts.chars").alias("word_chars"),
        _shorter(LEFT[3], F.regexp_replace(LEFT[3], r"[#*$%&|<>]+", "")).alias("n_symbols"),
        let(lines, lambda held: F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("n_dup_lines"),
        F.col("counts.repeated").alias("n_repeat_words"),
        F.col("counts")[kept].alias(kept),
        F.array(*class_counts(F.col("counts.chars"))).alias("classes"),
    )


def held_words(words: Column) -> Column:
    """How many of the document's words are each of the common ones, and how many others there are."""

    def counted(some: Column) -> Column:
        return F.transform("common", lambda w: F.size(some) - F.size(F.array_remove(some, w)))

    def with_others(each: Column) -> Column:
        return F.concat(each, F.array(F.size(words) - F.aggregate(each, F.lit(0), lambda a, c: a + c)))

    # One search in a short text leaves out most words that are none of the common ones; the counts are of whole words.
    some = F.filter(words, lambda w: F.contains(F.col("starts"), F.left(w, F.lit(START))))
    return let(let(some, counted), with_others).cast("array<long>")


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are there twice or more."""

    def window_hash(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(windows: Column) -> Column:
        # Sorted by hash and place, equal windows stand side by side.
        def repeated(window: Column, k: Column) -> Column:
            before, after = F.get(windows, k - 1)["h"], F.get(windows, k + 1)["h"]
            return F.coalesce(before == window["h"], F.lit(False)) | F.coalesce(after == window["h"], F.lit(False))

        places = F.transform(F.filter(windows, repeated), lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    def counted(hashes: Column) -> Column:
        windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0)).otherwise(let(windows, covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window_hash)
    return F.when(F.size(words) >= 3, let(hashes, counted)).otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def class_counts(word_chars: Column) -> list[Column]:
    """Code points of ``text`` that are white space, in each class, and all others."""
    named = [F.length("text").cast("long") - word_chars, *map(_shorter, LEFT, LEFT[1:])]
    return [*named, F.length("text").cast("long") - sum(named[1:], named[0])]


def references(rows: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Language, its class shares, its common words and their shares, and the others' share; ALL for all."""
    common = common_words(rows) if common is None else common
    rows = rows.filter(F.col("n_words") >= MIN_WORDS)
    classes = [f"c{i}" for i in range(len(CLASSES) + 2)]
    each = [F.get("classes", F.lit(i)).alias(name) for i, name in enumerate(classes)]
    sums = [F.sum(name).alias(name) for name in ("n", *classes)]
    counted = rows.select("lang", F.col("n_words").alias("n"), *each)
    by_language = stored(counted.groupBy("lang").agg(*sums), "languages")
    own = F.col("lang").isNotNull() & (F.col("lang") != ALL)
    whole = by_language.agg(*sums).select(F.lit(ALL).alias("lang"), "n", *classes)
    totals = by_language.filter(own).unionByName(whole).filter(F.col("n") > 0)

    shares = F.transform("top", lambda word: word["count"] / F.col("n"))
    total = sum((F.col(name) for name in classes[1:]), F.col(classes[0]))
    found = totals.join(common, F.col("lang") == F.col("ref")).select(
        "ref",
        F.array(*[F.col(name) / total for name in classes]).alias("ref_chars"),
        F.col("top.word").alias("common"),
        F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))).alias("ref_words"),
    )
    return stored(found, "references")


def jensen_shannon(counts: Column, shares: Column) -> Column:
    """Distance of a histogram of counts from one of shares; null where there are no counts."""

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0)) / 2

    def divergence(held: Column, total: Column) -> Column:
        bars = F.zip_with(held, shares, lambda n, q: let(n / total, lambda p: half(p, q) + half(q, p)))
        return F.aggregate(bars, F.lit(0.0), lambda a, b: a + b)

    def distance(held: Column) -> Column:
        total = F.aggregate(held, F.lit(0).cast("long"), lambda a, c: a + c)
        return let(total, lambda t: F.when(t > 0, F.sqrt(F.greatest(divergence(held, t), F.lit(0.0)))))

    return let(counts, distance)


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns as ``row``, the base counts, both distances and the verdict."""
    words = docs.select("lang", words_of_text().alias("words")).withColumn("n_words", F.size("words"))
    common = common_words(words)
    rows = stored(measured(docs, keep or docs.columns, common), "measured")
    rows = own_or_all(rows, references(rows, common), ["ref_chars", "ref_words"])
    rows = rows.withColumn("char_distance", jensen_shannon(F.col("classes"), F.col("ref_chars")))
    rows = rows.withColumn("word_distance", jensen_shannon(F.col("held"), F.col("ref_words")))
    n_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a + c)
    far = (n_chars >= MIN_CHARS) & (F.col("char_distance") > MOST_CHARS)
    most = F.lit(MOST_WORDS) + F.lit(WORD_NOISE) / F.sqrt("n_words")
    odd = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > most)
    verdict = ~base_failed() & ~F.coalesce(far, F.lit(False)) & ~F.coalesce(odd, F.lit(False))
    return rows.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict.alias("kept"), "char_distance", "word_distance",
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's row per document, with both distances behind."""
    return judged(docs, ["doc_id"]).select("row.doc_id", "*").drop("row")
