"""Connected components of an edge table by rounds of random-mate contraction.

Every round gives each node the smallest of itself and its neighbours under that round's hash, and
replaces both ends of each edge by what they were given. Edges shrink by a constant factor in the mean, so the
rounds grow with the logarithm of the longest chain and not with its length. Only built-in functions, joins and
aggregates; each round is a written table, and a hot node's rows are pre-aggregated before they are shuffled.

Defined cases: nulls at either end are no edge; loops and repeated edges change nothing; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoforge.session import written_once


def _order(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), node).alias("h"), node.alias("node"))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of an edge that is no loop."""
    now = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    now = written_once(now.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mates: list[DataFrame] = []
    while not now.isEmpty():
        turn = len(mates)
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                                            F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        mate = ends.groupBy("node").agg(F.min(_order(F.col("other"), turn)).alias("best"))
        mate = written_once(mate.select("node", F.least(F.col("best"), _order(F.col("node"), turn))["node"].alias("mate")), f"mates{turn}")
        mates.append(mate)
        moved = now.join(mate.select(F.col("node").alias("a"), F.col("mate").alias("ma")), "a").join(
            mate.select(F.col("node").alias("b"), F.col("mate").alias("mb")), "b").where("ma <> mb")
        now = written_once(moved.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), f"edges{turn}")
    if not mates:
        return now.select(F.col("a").alias("node"), F.col("a").alias("component"))
    # Follow the mates from the last round back to the first.
    root = mates[-1]
    for mate in reversed(mates[:-1]):
        later = root.select(F.col("node").alias("mate"), F.col("mate").alias("root"))
        root = mate.join(later, "mate", "left").select("node", F.coalesce("root", "mate").alias("mate"))
    root = written_once(root, "roots")
    least = root.groupBy("mate").agg(F.min("node").alias("component"))
    least = least.select("mate", F.least("component", "mate").alias("component"))
    # A root may itself never have been an end of a first-round edge only if it is one of the nodes: it always is.
    return root.join(least, "mate").select("node", "component")
