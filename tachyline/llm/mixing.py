"""Mixing sources to target weights, in equal blocks of words apportioned after Sainte-Laguë.

Targets: sources are numbered by the code points of their names, null last; their weights repeat
WEIGHTS. All words are shared out by weight, but no source gets more than LIMIT times its own; what
is over goes to the others by weight, until none is above.

Blocks: a source's k-th block has the quotient target / (2k - 1). The blocks with quotients of at least
block * SHARDS / (2 * (j + 1)) fill the first j + 1 output shards: that is the divisor form
of the highest quotients, so each source's integer quota for a shard follows from its target alone, is the
same wherever it is worked out, and no list of blocks is ever made. A block is BLOCK words, or a
hundredth of the smallest target where that is less, so that small sources come near theirs too.

Selection: the documents of a source are laid end to end in the order of a seeded hash, and its
blocks are cut from that row, shard by shard; a source that gives more than it has starts again from the
front. The mix is therefore a list of word ranges per document, with the shard and
the round each belongs to. A target of LIMIT times a source's size is the end: no document is taken more often.

Null and empty texts have no words: they are kept, with nothing taken. A source without words
has the target 0. Rows with the same doc_id and text are alike; with another text they are documents of their
own. Other columns are ignored. An empty table gives no rows. Sources are a distributed table throughout:
the driver sees sums alone. Places in a source's row are prefix sums over blocks of
hashes, so that a source that holds most rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tachyline.llm.common import stored

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK = 256
SHARDS = 16
SEED = 17
ROWS_A_BLOCK = 4_000


def numbered(names: DataFrame, column: str) -> DataFrame:
    """The rows with ``_number``, their place from 0 in the order of the column, nulls last."""
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(column).isNull(), F.col(column)]
    ordered = names.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("_id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = ordered.groupBy(part.alias("_part")).count()
    counts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return ordered.withColumn("_part", part).join(F.broadcast(counts), "_part").withColumn("_number", place).drop(
        "_part", "_before", "_id"
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) with each source's weight and target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_number") % len(weights) + 1).cast("int"))
    sources = stored(numbered(sizes, "source").withColumn("weight", weight.cast("long")), "mix-weights")
    most = F.col("source_size") * limit
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, full = 0.0, -1
    while total:
        over = F.coalesce(most < F.col("weight") * share, F.lit(False))
        sums = sources.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, most)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if sums[0] == full:
            break
        full, share = sums[0], (total - sums[1]) / sums[2]
    return sources.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(share))).drop("_number")


def quotas(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, limit: int = LIMIT) -> DataFrame:
    """The sources with ``bounds``: the words of each source's row at which its share of each shard begins and ends."""
    least = sources.filter("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(block, int((least or 0) // 100)))
    bounds = F.transform(
        F.sequence(F.lit(0), F.lit(shards)),
        lambda j: F.least(
            F.floor(F.col("target") * j / F.lit(float(block * shards)) + 0.5) * block, F.col("source_size") * limit
        ).cast("long"),
    )
    return sources.withColumn("bounds", bounds)


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK,
    shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """A row per document: its source's target, and the ranges of its words that the mix takes.

    ``slices`` holds (shard, round, first, end): words first to end - 1 of the document go to that shard.
    """
    doc_id = F.col("doc_id").cast("long")
    key = F.md5(
        F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    )
    rows = docs.select(
        doc_id.alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        key.alias("_key"),
    )
    rows = stored(rows, "mix-rows")
    blocks = rows.count() // ROWS_A_BLOCK + 1
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_block", F.shiftright(place * blocks, 32))

    sums = rows.groupBy("source", "_block").agg(F.sum("size").alias("_words"))
    sums = stored(sums, "mix-blocks")
    sizes = sums.groupBy("source").agg(F.sum("_words").alias("source_size"))
    plan = quotas(targets(sizes, weights, limit), block, shards, limit)
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_block", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    offsets = offsets.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))).select(
        F.col("o.source").alias("_source"), F.col("_block").alias("_place"), "_before", "source_size", "target", "bounds"
    )
    within = Window.partitionBy("source", "_block").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_end", F.sum("size").over(within)).join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_place"))
    )
    placed = placed.withColumn("_first", F.col("_before") + F.col("_end") - F.col("size"))
    slices = F.expr(
        f"""filter(flatten(transform(sequence(0, {limit - 1}), r -> transform(sequence(0, {shards - 1}), j -> struct(
            j as shard, r as round,
            greatest(bounds[j] - _first - r * source_size, 0L) as first,
            least(bounds[j + 1] - _first - r * source_size, size) as end)))), s -> s.end > s.first)"""
    )
    return placed.select("doc_id", "source", "size", "source_size", "target", slices.alias("slices"))


def digests(docs: DataFrame) -> DataFrame:
    """A row per document: its size, its source's size and target, and how many words the mix takes of it."""
    taken = F.expr("aggregate(slices, 0L, (sum, s) -> sum + s.end - s.first)")
    return mixed(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: The same in SQL: the blocks need not be listed there either, since a source's row is taken from its front.
SQL = f"""
WITH rows AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS s, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
    FROM rows GROUP BY source
), steps AS (
    SELECT w, s, row_number() OVER before AS i, (sum(s) OVER () - {LIMIT} * coalesce(sum(s) OVER before, 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS share
    FROM sources
    WINDOW before AS (ORDER BY s::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
    SELECT arg_min(share, i) FILTER (WHERE {LIMIT} * s >= w * share) AS share FROM steps
), plan AS (
    SELECT source, s, least({LIMIT} * s::DOUBLE, w * share) AS target FROM sources, chosen
), sized AS (
    SELECT *, greatest(1, least({BLOCK}, floor((SELECT min(target) FROM plan WHERE target > 0) / 100))) AS block FROM plan
), quota AS (
    SELECT *, least(floor(target * {SHARDS} / (block * {SHARDS}) + 0.5) * block, {LIMIT} * s) AS q FROM sized
), placed AS (
    SELECT r.*, q.s, q.target, q.q, sum(size) OVER (PARTITION BY r.source ORDER BY k ROWS UNBOUNDED PRECEDING) AS e
    FROM rows r JOIN quota q ON r.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target::DOUBLE AS target,
    (SELECT sum(least(q, e + i * s) - least(q, e - size + i * s)) FROM range({LIMIT}) t(i))::BIGINT AS taken
FROM placed
"""
