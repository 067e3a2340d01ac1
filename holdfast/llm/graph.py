"""Connected components as Spark joins, and their small in-task counterpart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import keep


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of n nodes, by hooking and pointer jumping."""
    lab = np.arange(n) if labels is None else labels.copy()
    while len(a):
        la, lb = lab[a], lab[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(lab, la, low)
        np.minimum.at(lab, lb, low)
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
    return lab


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over (a, b) with b < a."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m")
    )
    met = near.join(low, F.col("u") == F.col("w"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # the link to the minimum itself becomes (u, m); every other one becomes (v, m)
        out = met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being the smallest node reachable.

    Large-star and small-star steps alternate until no link moves; each round is stored,
    so its lineage is one file scan. No group is gathered in one task.
    """
    now = keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    sign = None
    while True:
        new = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if sign == tuple(new) or not new[0]:
            break
        sign = tuple(new)
        now = keep(_star(_star(now, True), False), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
