"""Connected components of large edge tables, in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, written


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Each edge with the least `other` of its `key`; one hub may hold a third of all edges."""
    least = edges.groupBy(key).agg(F.min(other).alias("m"), F.count("*").alias("n"))
    return lookup(edges, least, key, "n")


#: Edges that are joined on the driver (16 bytes each), where rounds of jobs would take longer.
FEW = 100_000


def _few(links: DataFrame) -> DataFrame:
    """The components of FEW edges between longs, or fewer."""
    found = links.toArrow()
    ends = np.concatenate([found.column(c).to_numpy() for c in ("u", "v")])
    nodes, place = np.unique(ends, return_inverse=True)
    parent = np.arange(len(nodes))
    unite(parent, place[: len(place) // 2], place[len(place) // 2 :])
    if not len(nodes):
        return links.sparkSession.createDataFrame([], "node long, component long")
    return written(links.sparkSession.createDataFrame(pa.table({"node": nodes, "component": nodes[parent]})), "few")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) of every node with an edge: component is the smallest node it reaches.

    FEW edges or fewer between longs are joined on the driver. For more, it
    alternates large stars and small stars until only stars remain. Every round
    is a written table, so lost executors cost a round at most; no neighbour
    list is ever gathered. Self edges, repeated edges and nulls don't matter.
    """
    a, b = edges.columns[:2]
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = written(links.distinct(), "links")
    if [t for _, t in links.dtypes] == ["bigint", "bigint"] and links.count() <= FEW:
        return _few(links)
    for _ in range(rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, "u", "v").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = written(large.where("u > v").distinct(), "large")
        near = _least(large, "u", "v")
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "small")
        discard(links, large)
        # Only stars remain when no parent has a parent.
        chained = after.select("v").distinct().join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        links = after
        if chained.isEmpty() and links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def roots(parent, nodes=None):
    """Flattens a numpy parent array in place until every entry is a root."""
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent[:] = above


def unite(parent, a, b) -> None:
    """Joins the trees of a[i] and b[i] in a flat numpy parent array, which stays flat."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        roots(parent)
