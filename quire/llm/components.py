"""Connected components of a link table, by contracting it round after round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import join_small, materialize


def contract(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of the component of each of ``n`` nodes linked by pairs (a, b), in memory."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, component), component being the least node reachable.

    In each round every node points to its least neighbour, pointers are followed to their roots,
    and links are rewritten between roots; links inside a component vanish. Rounds are few, as
    each at least halves the roots that still have links. Every round is written to the shared
    folder. Nodes without a link to another node are not in the result.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found: DataFrame | None = None
    turn = 0
    while links.head(1):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), f"points-{turn}")
        rows = point.count()
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("top"))
            after = join_small(point, up, ["root"], "left", rows).select("node", F.coalesce("top", "root").alias("root"), (F.col("top") != F.col("root")).alias("moved"))
            after = materialize(after, f"jump-{turn}")
            moved = after.where("moved").head(1)
            point = after.select("node", "root")
            if not moved:
                break
        if found is None:
            found = point
        else:
            up = point.select(F.col("node").alias("component"), "root")
            found = materialize(join_small(found, up, ["component"], "left", rows).select("node", F.coalesce("root", "component").alias("component")), f"found-{turn}")
        if turn == 0:
            found = found.select("node", F.col("root").alias("component"))
        a = join_small(links, point.select(F.col("node").alias("a"), F.col("root").alias("ra")), ["a"], "inner", rows)
        ab = join_small(a, point.select(F.col("node").alias("b"), F.col("root").alias("rb")), ["b"], "inner", rows)
        links = materialize(ab.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"links-{turn}")
        turn += 1
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
