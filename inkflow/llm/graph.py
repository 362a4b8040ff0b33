"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, with_minimum


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), longs; root is the least node reachable.

    Every step replaces edges by edges to the least neighbour, by grouped minima and joins only.
    A hub's edges are dealt over many tasks in both (``with_minimum``). Edges between steps are
    files in the shared folder. The loop ends when a step changes nothing.
    """
    now = Stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        e = now.df
        near = with_minimum(e.union(e.select("v", "u")), "u", "v", "low")
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        small = with_minimum(large, "u", "v", "low")
        ends = F.explode(F.array(F.struct("u", "low"), F.struct(F.col("v").alias("u"), "low"))).alias("e")
        after = Stored(small.select(ends).select(F.col("e.u").alias("u"), F.col("e.low").alias("v")).where("u <> v").distinct())
        last, now = now, after
        last.drop()
        seen = after.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            roots = after.df.select(F.col("v").alias("node")).distinct()
            return after.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
        mark = seen


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable index of each of n nodes, for edges a-b."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def trees(label: np.ndarray, degree: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For components of more than one node, edges (child, parent) of a tree of bounded degree."""
    order = np.argsort(label, kind="stable")
    own = label[order]
    first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
    rank = np.arange(len(own)) - start
    child = rank > 0
    return order[child], order[(start + (rank - 1) // degree)[child]]
