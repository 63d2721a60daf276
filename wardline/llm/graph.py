"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.shared import Scratch


def _star(links: DataFrame, scratch: Scratch, larger: bool) -> DataFrame:
    """Hang each node's larger (or not larger) neighbours on its smallest neighbour.

    The smallest neighbour per node is an aggregate with map-side combine, and is written before it
    is joined, so that a node with very many links can be split by the adaptive skew join.
    """
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = scratch.keep(ways.groupBy("a").agg(F.min("b").alias("least")), "least")
    if larger:
        moved = (
            ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        )
    else:
        moved = (
            links.join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(least.select("a", F.col("least").alias("b")))
        )
    kept = scratch.keep(moved.where("a <> b").distinct(), "star")
    scratch.drop(least)
    return kept


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is the smallest node reached.

    Null ends are ignored. Links may repeat and come in either direction. An empty table gives an empty one.
    """
    ordered = (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now, state = scratch.keep(ordered, "links"), None
    while True:
        large = _star(now, scratch, larger=True)
        small = _star(large, scratch, larger=False)
        scratch.drop(now, large)
        now = small
        # Every node hangs on one other, and none of those hangs on a third: the stars are final.
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(found):
            break
        state = tuple(found)
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
