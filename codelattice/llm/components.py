"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import finished, stored


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(pmod(xxhash64(b, a), 1000003) as bigint))")).first()
    return tuple(row)


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """Each (a, b) with ``m``, the smallest of a and all its b."""
    smallest = stored(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return pairs.join(smallest, "a")


def connected_components(links: DataFrame) -> DataFrame:
    """Stored (node, root) for every node of the links (a, b); root is the smallest node reachable.

    Rounds alternate two steps: all larger neighbours of a node are hung on its
    smallest neighbour, then all smaller ones are. The number of links never
    grows, and the number of rounds grows with the logarithm of the longest
    chain; rounds end when the links stay as they are. The smallest neighbour is combined before its shuffle, so a node
    with very many links is no hot group; the join back is one that adaptive
    execution can split. Every step is written to the shared folder.
    Links with a null end are dropped; those from a node to itself keep it.
    """
    return finished(links.sparkSession, lambda: _roots(links))


def _roots(links: DataFrame) -> DataFrame:
    whole = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    current = stored(whole.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = current
    current = stored(current.filter("a != b"))
    before = _state(current)
    while True:
        both = stored(current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        hung = _to_smallest(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(hung.filter("a != b").distinct())
        smaller = _to_smallest(large)
        hung = smaller.select(F.col("b").alias("a"), F.col("m").alias("b")).union(smaller.select("a", F.col("m").alias("b")))
        current = stored(hung.filter("a != b").distinct())
        after = _state(current)
        if after == before:
            break
        before = after
    every = nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct()
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
