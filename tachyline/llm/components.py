"""Connected components of a graph of 64-bit nodes, by alternating large and small stars.

Every round replaces the edges by edges towards the smallest known node of each neighbourhood; the
rounds end when nothing changes, which takes a number logarithmic in the nodes. Edges are
written to the shared checkpoint folder each round. Minima are aggregated before the
shuffle, and each operation makes at most a row per edge and node, so a hub costs its own edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tachyline.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter(F.col("v") != F.col("m"))
    return others.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) that isn't its component's smallest, the root."""
    edges = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = stored(edges.distinct(), "links")
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "stars")


class Sets:
    """Union-find over the indexes of a list."""

    def __init__(self, count: int):
        self.above = list(range(count))

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.above[max(i, j)] = min(i, j)
        return True

    def roots(self) -> list[int]:
        return [self.root(i) for i in range(len(self.above))]
