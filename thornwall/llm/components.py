"""Connected components of a link table, distributed and with bounded groups.

Alternating star operations: a large star links every larger neighbour of a node to the smallest of its neighbours and
itself, a small star does the same with the node and its smaller neighbours, until nothing changes and every node
links to the smallest of its component. Each star is a minimum per node, combined before the shuffle, and a join of
the links with these minima, so a node with very many links never meets in one task: adaptive execution splits the
join's hot side. The number of rounds is logarithmic for usual inputs, and each round's table is written to the shared
folder. Nothing but counts goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), two longs, in any direction, repeats allowed.

    Nodes without links don't appear. component is the smallest node reachable.
    """
    pairs = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).where("node <> low").distinct()
    pairs = materialize(pairs, "links")
    before = content(pairs)
    while True:
        # large star: every larger neighbour of a node goes to the smallest of its neighbours and itself
        both = pairs.select("node", F.col("low").alias("next")).unionByName(pairs.select(F.col("low").alias("node"), F.col("node").alias("next")))
        least = both.groupBy("node").agg(F.min("next").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.where("next > node").join(least, "node").select(F.col("next").alias("node"), F.col("least").alias("low")).where("node <> low").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        lower = large.groupBy("node").agg(F.min("low").alias("least"))
        small = large.join(lower, "node").select(F.when(F.col("low") == F.col("least"), F.col("node")).otherwise(F.col("low")).alias("node"), F.col("least").alias("low"))
        small = materialize(small.distinct(), "links")
        if (after := content(small)) == before:
            return small.select("node", F.col("low").alias("component")).unionByName(small.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
        pairs, before = small, after


def content(pairs: DataFrame) -> tuple:
    """A digest of a table of distinct pairs: its size and sums of two hashes."""
    hashes = [F.sum(F.expr(f"cast(xxhash64(node, low, {i}L) as decimal(20))")) for i in range(2)]
    return tuple(pairs.agg(F.count("*"), *hashes).first())
