"""Graph measures of weighted edges as DataFrame operations: no Python on executors.

A graph keeps the strongest edges of a segment, those at or above a percentile
of its weights. Each segment is a row with its neighbour lists (at most
channels squared numbers), and its measures are higher-order functions on them:
triangles by intersecting neighbour lists, distances by a breadth-first
frontier from each node. All segments are worked on at once, wherever their
rows lie.

A segment without edges has clustering and efficiency 0 and path length n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import series


def percentile(values: Column, share: float) -> Column:
    """Linear interpolation between order statistics; values must be in order."""
    at = (F.size(values) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = values[low], values[F.least(low + 1, F.size(values) - 1)]
    return a + (b - a) * (at - low)


def thresholded(lists: DataFrame, keep: float = 0.3) -> DataFrame:
    """Rows with edges (i, j, w): column edges keeps those whose weight is in the upper share `keep`."""
    cut = lists.withColumn("__w", F.array_sort(F.transform("edges", lambda e: e["w"]))).withColumn("__cut", percentile(F.col("__w"), 1 - keep))
    return cut.withColumn("edges", F.filter("edges", lambda e: e["w"] >= F.col("__cut"))).drop("__w", "__cut")


def neighbours(edges: Column, n: int) -> Column:
    """The neighbour list of each of n nodes."""
    near = lambda v: F.transform(F.filter(edges, lambda e: (e["i"] == v) | (e["j"] == v)), lambda e: F.when(e["i"] == v, e["j"]).otherwise(e["i"]))
    # named twice, so that the optimiser keeps the edges as a column and doesn't compute them for each node
    return F.when(edges.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), near))


def clustering(adjacency: Column) -> Column:
    """Mean share of linked pairs among a node's neighbours; nodes with fewer than two count as 0."""

    def of(near: Column) -> Column:
        k = F.size(near).cast("double")
        links = F.aggregate(near, F.lit(0), lambda a, j: a + F.size(F.array_intersect(near, adjacency[j])))
        return F.when(k >= 2, links / (k * (k - 1))).otherwise(0.0)

    return series.mean(F.transform(adjacency, of))


def distances(adjacency: Column, n: int) -> Column:
    """(count, total, inverse) over all ordered pairs of nodes with a way between them: how many, their steps and the sum of 1 / steps."""
    zero = F.struct(F.lit(0.0).alias("count"), F.lit(0.0).alias("total"), F.lit(0.0).alias("inverse"))

    def step(s: Column, d: Column) -> Column:
        fresh = F.array_except(F.flatten(F.transform(s["front"], lambda v: adjacency[v])), s["seen"])
        more = F.size(fresh).cast("double")
        grown = F.struct(F.array_union(s["seen"], fresh).alias("seen"), fresh.alias("front"), (s["count"] + more).alias("count"), (s["total"] + more * d).alias("total"), (s["inverse"] + more / d).alias("inverse"))
        return F.when(F.size(s["front"]) == 0, s).otherwise(grown)

    def from_node(v: Column) -> Column:
        start = F.struct(F.array(v).alias("seen"), F.array(v).alias("front"), *[F.lit(0.0).alias(c) for c in ("count", "total", "inverse")])
        end = F.aggregate(F.sequence(F.lit(1), F.lit(max(n - 1, 1))), start, step)
        return F.struct(end["count"].alias("count"), end["total"].alias("total"), end["inverse"].alias("inverse"))

    per_node = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), from_node)
    return F.aggregate(per_node, zero, lambda a, r: F.struct(*[(a[c] + r[c]).alias(c) for c in ("count", "total", "inverse")]))


def measures(lists: DataFrame, n: int, keep: float = 0.3, keys: tuple[str, ...] = ("seg",)) -> DataFrame:
    """The four network features of graphs of n nodes given by all their weighted edges (keys, edges)."""
    rows = thresholded(lists, keep).withColumn("__adj", neighbours(F.col("edges"), n))
    rows = rows.withColumns({"__c": clustering(F.col("__adj")), "__d": distances(F.col("__adj"), n)})
    d = F.col("__d")
    degree = max(1.0, keep * n)
    c0, p0 = degree / n, math.log(n) / math.log(degree) if degree > 1 else float(n)
    c, path = F.col("__c"), F.when(d["count"] > 0, d["total"] / d["count"]).otherwise(float(n))
    efficiency = d["inverse"] / (n * (n - 1)) if n > 1 else F.lit(0.0)
    rows = rows.withColumns({"__path": path})
    path = F.col("__path")
    small = F.when(path > 0, (c / c0) / (path / p0)).otherwise(1.0) if c0 > 0 and p0 > 0 else F.lit(1.0)
    names = ("network_clustering_coefficient", "network_characteristic_path_length", "network_global_efficiency", "network_small_world_index")
    return rows.select(*keys, *[v.alias(m) for m, v in zip(names, (c, path, efficiency, small), strict=True)])
