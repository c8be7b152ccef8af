"""Connected components: contraction rounds over DataFrames, and a local form for the edges of one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (u long, v long); component is the smallest id it reaches.

    Each round points every vertex at its smallest neighbour, follows the pointers four steps and contracts the
    edges; rounds grow with the logarithm of the longest path. All tables stay distributed, in the shared folder.
    """
    e = common.save(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    labels = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = common.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "cc-hook")
        for _ in range(2):
            q = p.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = common.save(p.join(q, "p").select("u", F.col("q").alias("p")), "cc-jump")
            common.drop(p)
            p = jumped
        if labels is None:
            labels = p
        else:
            more = p.select(F.col("u").alias("p"), F.col("p").alias("q"))
            composed = common.save(labels.join(more, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "cc-labels")
            common.drop(labels)
            labels = composed
        ends = p.select(F.col("u"), F.col("p").alias("pu"))
        moved = e.join(ends, "u").select("pu", F.col("v").alias("u")).join(ends.withColumnRenamed("pu", "pv"), "u")
        left = moved.filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        left = common.save(left, "cc-edges")
        common.drop(e)
        e = left
        if e.isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("p").alias("component"))


def local_labels(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 through the edges u-v and earlier labels."""
    lab = np.arange(n) if labels is None else labels
    while True:
        a, b = lab[u], lab[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        differ = low != high
        if not differ.any():
            return lab
        low, high, u, v = low[differ], high[differ], u[differ], v[differ]
        np.minimum.at(lab, high, low)
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab = nxt
