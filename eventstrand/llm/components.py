"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventstrand.llm.common import Scratch

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large star) or not larger (small star) neighbours on its smallest one."""
    if large:
        links = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    near = links.join(smallest, "a")
    if large:
        moved = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of the links ``a, b``; a <> b.

    ``links`` are read twice, so they should be stored.  Each round halves the distance to the smallest node
    or better and is a stored table.  Nodes that are components' smallest are not listed.
    """
    current = scratch.keep(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        f"{name}-0", links.count(),
    )
    n_links, state = current.count(), None
    for k in range(1, MAX_ROUNDS):
        # a round leaves at most a link a link, and one a node
        current = scratch.keep(_star(_star(current, large=True), large=False), f"{name}-{k}", 2 * n_links)
        last, state = state, current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
