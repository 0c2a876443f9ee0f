"""Connected components of an edge table, without collecting it.

Each round every node takes its least neighbour as parent, follows one more parent pointer,
and the edges are contracted to those representatives. Least-neighbour trees at least halve
the nodes that still have an edge, so the rounds are logarithmic in the longest chain.
Every round's tables are written to the shared folder, so lineage stays short and a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b longs); label is the least node of its component.

    Self loops, repeated and reversed edges are harmless. Nodes without a (non-loop) edge are absent.
    """
    e = save(_tidy(edges), f"{path}/edges-0")
    label: DataFrame | None = None
    k = 0
    while not e.isEmpty():
        k += 1
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p")), f"{path}/parent-{k}")
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        jump = save(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")), f"{path}/jump-{k}")
        a, b = jump.select(F.col("node").alias("a"), F.col("p").alias("pa")), jump.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        e = save(_tidy(e.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), f"{path}/edges-{k}")
        if label is None:
            label = jump.select("node", F.col("p").alias("label"))
        else:
            step = jump.select(F.col("node").alias("label"), F.col("p").alias("next"))
            label = label.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        label = save(label, f"{path}/label-{k}")
    if label is None:
        label = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return label


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
