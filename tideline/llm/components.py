"""Connected components of an edge table, wholly distributed.

Alternating large-star and small-star steps: every step is an aggregate and a
join on narrow rows, the number of steps grows with the logarithm of the
input, and each round is written to the shared folder. No node's neighbours
are ever collected. Edges go from the larger node to the smaller one, so that
in a large step only nodes with a smaller neighbour have something to tell and
each edge is read once; aggregates combine before the shuffle, and the joins
are left to the adaptive planner, which splits the partition of a hub.

Edges with a null end are ignored; loops and repeated edges change nothing.
An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges a > b: link each a to the least node near b (large), or a and its neighbours to a's least one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        near = edges.join(least.select(F.col("a").alias("c"), "m").hint("merge"), F.col("b") == F.col("c"), "left")
        return near.select("a", F.coalesce("m", "b").alias("b"))
    near = edges.join(least.hint("merge"), "a")
    return near.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, component) for every node of edges (a, b); component is the least node."""
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = mark(now)
    while before[0]:
        last, now = now, written(_star(_star(now, True), False).distinct(), label)
        discard(last)
        after = mark(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).distinct()
