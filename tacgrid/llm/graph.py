"""Connected components by alternating large and small stars, on DataFrames only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacgrid.llm.base import materialise, skew_join


def local_roots(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest number in each number's component, for numbers below n linked by (a, b)."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while True:  # every label points to a root
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs, a <> b -> (node, root): root is the smallest node of the component. No edges: no rows.

    Hubs are met by partial minima before each shuffle and by joins that Spark can split; nothing is gathered by node.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both, least, ["u"], "inner").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(large, low, ["a"], "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        if (now := _state(edges)) == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
