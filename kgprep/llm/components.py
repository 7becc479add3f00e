"""Connected components by randomised contraction, every round written to the shared folder.

In each round every node points at the node of its closed neighbourhood that
comes first in a random order of that round, and edges move to those
pointers; an edge whose ends meet is done.  The random order makes a
constant share of the nodes disappear in each round whatever the graph, long
chains included (Boegeholz et al., "In-database connected component
analysis", ICDE 2020).  A hub is a partial aggregate: its rows combine
before the shuffle.  Pointers are resolved back from the last round to the
first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgprep.llm.common import written


def component_minimum(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, label) for every node of the ``(a, b)`` edges: the label is a
    node of the component, the same for all of its nodes.

    No edges give no rows; loops and repeated edges are harmless.
    """
    current = edges.select("a", "b").where("a <> b")
    pointers = []
    while not current.isEmpty():
        if len(pointers) >= max_rounds:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
        turn = F.lit(len(pointers))
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", F.xxhash64(turn, "b")).alias("m"))
        ahead = F.xxhash64(turn, "m") < F.xxhash64(turn, "a")
        parent = written(first.select(F.col("a").alias("node"),
                                      F.when(ahead, F.col("m")).otherwise(F.col("a")).alias("p")), "pointers")
        pointers.append(parent)
        moved = (current.join(parent.withColumnRenamed("node", "a").withColumnRenamed("p", "pa"), "a")
                 .join(parent.withColumnRenamed("node", "b").withColumnRenamed("p", "pb"), "b"))
        current = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                          .where("a <> b").distinct(), "edges")
    if not pointers:
        return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = pointers[-1].withColumnRenamed("p", "label")
    for parent in reversed(pointers[:-1]):
        up = labels.select(F.col("node").alias("p"), "label")
        labels = parent.join(up, "p", "left").select("node", F.coalesce("label", "p").alias("label"))
        labels = written(labels, "labels")
    return labels
