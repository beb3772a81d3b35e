"""Clustering of integer vectors around centroids, filtered by n-simplex projection.

Vectors of DIMENSIONS finite components become integers floor(SCALE * x). The first centroids also
serve as pivots. The distances of a vector to n pivots fix it as the apex of a simplex over the pivots: n - 1
coordinates in their space and an altitude above it. These coordinates are worked out once, kept beside
the vector and used in every round. For two apexes, the Euclidean distance is a lower bound of
the true distance, and with one altitude turned over it is an upper bound. A centroid
whose lower bound exceeds another's upper bound is out; the rest are compared by exact integer distances, ties going to
the smaller number. Bounds are widened by far more than their rounding errors, so no result hangs on them.

New centroids are componentwise floor(sum / count) over their vectors. Tasks send sums of their
vectors, cut into limbs of 48 bits, so that sums are exact whatever the components' size; the driver sees the sums
of a few centroids and never a vector.

Left out, by rule: null vectors, other numbers of components, components that are null, NaN or infinite. Fewer vectors
than centroids give that many centroids, none gives no rows. Equal vectors may make equal
centroids: all go to the smallest number, and the empty ones stay where they are. Rows that share a vec_id are vectors of
their own, as seeds in the order of their components; a null vec_id comes last among the seeds. A distance or an inertia
beyond 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachyline.llm.common import in_arrow, stored

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
ROWS_AT_ONCE = 4096
#: Components up to this bound keep squared distances within 64 bits.
MOST_EXACT = 1 << 27
LIMB = 48


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers, or as Python's where one doesn't fit MOST_EXACT."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max() < MOST_EXACT:
        return scaled.astype(np.int64)
    exact = [[floor(Fraction(x) * SCALE) for x in row] for row in values.tolist()]
    return np.array(exact, object).reshape(values.shape)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each vector as bytes: 32-bit integers, or its decimals where they don't fit MOST_EXACT."""
    if rows.dtype == np.int64:
        return [row.tobytes() for row in rows.astype("<i4")]
    small = np.abs(rows).max(axis=1) < MOST_EXACT
    return [
        row.astype(np.int64).astype("<i4").tobytes() if fits else (b"," + b",".join(b"%d" % x for x in row)).ljust(4 * len(row) + 1)
        for row, fits in zip(rows, small)
    ]


def unpacked(cells: list[bytes], dimensions: int) -> np.ndarray:
    if all(len(cell) == 4 * dimensions for cell in cells):
        return np.frombuffer(b"".join(cells), "<i4").reshape(-1, dimensions).astype(np.int64)
    rows = [
        np.frombuffer(cell, "<i4").tolist() if len(cell) == 4 * dimensions else [int(x) for x in cell[1:].split(b",")]
        for cell in cells
    ]
    return np.array(rows, object).reshape(-1, dimensions)


@dataclass
class Simplex:
    """Pivots whose simplex is well away from flat, and the map from distances to apex coordinates."""

    pivots: np.ndarray
    corners: np.ndarray = field(init=False)
    inverse: np.ndarray = field(init=False)

    def __post_init__(self):
        points, chosen, corners = self.pivots.astype(float), [0], np.zeros((1, 0))
        for i in range(1, len(points)):
            apex = self._apex(self._squares(points[i : i + 1], points[chosen]), corners)[0]
            if apex[-1] > 0.05 * np.sqrt((apex**2).sum()) > 0:
                corners = np.vstack([np.hstack([corners, np.zeros((len(corners), 1))]), apex])
                chosen.append(i)
        self.pivots, self.corners = self.pivots[chosen], corners
        self.inverse = np.linalg.inv(corners[1:]) if len(chosen) > 1 else np.zeros((0, 0))

    @staticmethod
    def _squares(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        rows, pivots = rows.astype(float), pivots.astype(float)
        with np.errstate(over="ignore", invalid="ignore"):  # beyond floats, vectors are compared without bounds
            squares = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * rows @ pivots.T
            return np.maximum(squares, 0)

    @staticmethod
    def _apex(squares: np.ndarray, corners: np.ndarray, inverse: np.ndarray | None = None) -> np.ndarray:
        """The pivots' first corner is the origin; a distance to another gives one linear equation."""
        base = corners[1:]
        if inverse is None:
            inverse = np.linalg.inv(base) if len(base) else np.zeros((0, 0))
        with np.errstate(over="ignore", invalid="ignore"):
            sides = ((base**2).sum(1)[None, :] + squares[:, :1] - squares[:, 1:]) / 2
            flat = sides @ inverse.T
            return np.hstack([flat, np.sqrt(np.maximum(squares[:, :1] - (flat**2).sum(1)[:, None], 0))])

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates over the pivots, the altitude last."""
        return self._apex(self._squares(rows, self.pivots), self.corners, self.inverse)

    def slack(self, size: np.ndarray) -> np.ndarray:
        """More than what rounding can do to a squared bound between points whose squared norms sum to ``size``."""
        size = size + float((self.pivots.astype(float) ** 2).sum(1).max())
        return 1e-12 * size * (1 + np.linalg.norm(self.inverse) ** 2 * size)


def nearest(
    rows: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex
) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and the squared distance, both exact."""
    count = len(centroids)
    if rows.dtype == object or centroids.dtype == object:
        found = [min((sum((a - b) ** 2 for a, b in zip(row, c)), i) for i, c in enumerate(centroids.tolist())) for row in rows.tolist()]
        return np.array([i for _, i in found], np.int64), np.array([d for d, _ in found], object)
    over = simplex.apexes(centroids)
    # both bounds share the distance within the pivots' space and differ by the altitudes' product
    flat = (apexes[:, None, :-1] - over[None, :, :-1]) ** 2
    flat = flat.sum(2)
    low = flat + (apexes[:, -1:] - over[None, :, -1]) ** 2
    high = flat + (apexes[:, -1:] + over[None, :, -1]) ** 2
    norms = (rows.astype(float) ** 2).sum(1) + float((centroids.astype(float) ** 2).sum(1).max(initial=0))
    open_ = low <= high.min(axis=1, keepdims=True) + 2 * simplex.slack(norms)[:, None]
    row, column = np.nonzero(open_)
    distances = np.full((len(rows), count), np.iinfo(np.int64).max, np.int64)
    distances[row, column] = ((rows[row] - centroids[column]) ** 2).sum(1)
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(rows)), cluster]


def vectors(frame: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter((F.size("embedding") == dimensions) & ~bad)


def first_centroids(kept: DataFrame, count: int, dimensions: int) -> np.ndarray:
    """The vectors with the smallest hashes of their round number and id."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(name.asc_nulls_last(), "embedding").limit(count).collect()
    return integers(np.array([row["embedding"] for row in rows], float).reshape(len(rows), dimensions))


def with_apexes(kept: DataFrame, simplex: Simplex, dimensions: int) -> DataFrame:
    """(vec_id, cell, apex): the integers and the cached coordinates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                rows = integers(some.column(1).flatten().to_numpy().reshape(-1, dimensions))
                apexes = np.ascontiguousarray(simplex.apexes(rows.astype(float)))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(packed(rows), pa.binary()), pa.array([a.tobytes() for a in apexes], pa.binary())],
                    names=["vec_id", "cell", "apex"],
                )

    return kept.transform(in_arrow, work, "vec_id long, cell binary, apex binary")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, simplex: Simplex):
    """Per slice: the batch, its integer rows, clusters and distances."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(at, ROWS_AT_ONCE)
            rows = unpacked(some.column(1).to_pylist(), centroids.shape[1])
            apexes = np.frombuffer(b"".join(some.column(2).to_pylist()), float).reshape(len(rows), -1)
            yield some, rows, *nearest(rows, apexes, centroids, simplex)


def moved(cached: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round; every task sends one sum per centroid and component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = defaultdict(int)
        for _, rows, clusters, _ in _assigned(batches, centroids, simplex):
            for cluster in np.unique(clusters).tolist():
                own = rows[clusters == cluster]
                sums[cluster, -1] += len(own)
                for part, value in enumerate(own.sum(axis=0).tolist()):
                    sums[cluster, part] += value
        limbs = []
        for (cluster, part), value in sums.items():
            sign, value, place = (-1 if value < 0 else 1), abs(value), 0
            while value:
                limbs.append((cluster, part, place, sign * (value & ((1 << LIMB) - 1))))
                value, place = value >> LIMB, place + 1
        if limbs:
            names = ["cluster", "part", "place", "value"]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*limbs), kinds)], names=names)

    partial = cached.transform(in_arrow, work, "cluster int, part int, place int, value long")
    sums: dict[tuple[int, int], int] = defaultdict(int)
    for row in partial.groupBy("cluster", "part", "place").agg(F.sum("value").alias("value")).collect():
        sums[row["cluster"], row["part"]] += row["value"] << (LIMB * row["place"])
    after = centroids.tolist()
    for cluster, old in enumerate(after):
        count = sums[cluster, -1]
        if count:
            after[cluster] = [sums[cluster, part] // count for part in range(len(old))]
    exact = np.array(after, object)
    return exact if np.abs(exact).max() >= MOST_EXACT else exact.astype(np.int64)


def clustered(
    frame: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS
) -> DataFrame:
    """A row per vector with its cluster, its distance, and the inertia and digest of the cluster."""
    spark = frame.sparkSession
    kept = vectors(frame, dimensions)
    centroids = first_centroids(kept, count, dimensions)
    if not len(centroids):
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    simplex = Simplex(centroids)
    cached = stored(with_apexes(kept, simplex, dimensions), "vectors")
    for _ in range(rounds):
        centroids = moved(cached, centroids, simplex)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, clusters, distances in _assigned(batches, centroids, simplex):
            held = [d if d < 1 << 63 else None for d in distances.tolist()]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(clusters, pa.int32()), pa.array(held, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    assigned = stored(cached.transform(in_arrow, work, "vec_id long, cluster int, distance long"), "clusters")
    exact = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {row["cluster"]: row["sum"] for row in assigned.groupBy("cluster").agg(exact.alias("sum")).collect()}
    whole = None if None in sums.values() else sum(sums.values())

    def in_long(value):
        return int(value) if value is not None and value < 1 << 63 else None

    rows = [
        (
            cluster, in_long(sums[cluster]), in_long(whole),
            hashlib.sha256(",".join(map(str, centroids[cluster].tolist())).encode()).hexdigest(),
        )
        for cluster in sorted(sums)
    ]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql() -> str:
    """The rounds one after the other, each with the distances of all vectors to all centroids."""
    squares = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
)""",
        f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS n, v FROM kept
    ORDER BY sha256('1:' || vec_id), v LIMIT {CENTROIDS}
)""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
    SELECT id, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min(({squares}, c.n)) AS best
    FROM kept k, c{i} c GROUP BY id
)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
    SELECT c.n, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
        SELECT n, list(((s - ((s % t) + t) % t) // t)::BIGINT ORDER BY i) AS v FROM (
            SELECT best[2] AS n, i, sum(v[i])::BIGINT AS s, count(*) AS t
            FROM a{i}, range(1, {DIMENSIONS + 1}) g(i) GROUP BY ALL
        ) GROUP BY n
    ) m ON c.n = m.n
)"""
            )
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance,
    sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia, sum(best[1]) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.n = best[2]
"""
    )


SQL = _sql()
