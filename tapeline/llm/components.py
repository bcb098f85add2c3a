"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node that it reaches) in place of the links a-b; no self-links."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        for end in (x, y):
            np.minimum.at(label, before[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            break
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches.

    links: a, b of one comparable type, at any number and in any order; self-links say nothing. Each
    round is two joins of the links with one minimum per node and is written to the shared folder;
    the number of rounds grows with the logarithm of the longest chain.
    """
    stars = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        small = small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct()
        stars = written(small, "stars")
        before, state = state, _state(stars)
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
