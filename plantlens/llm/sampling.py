"""Repeated windows by a sparse de Bruijn graph: what substring and suffix dedup share.

A node is a sampled k-mer of a sequence: the least-hashed one of every window of the repeat length.  Equal
windows sample the same k-mer at the same place, so they share a node.  An *edge* is the stretch of all
windows that chose one occurrence of a node; its hash covers the whole stretch and the node's place in it.
A node with one edge content does not branch: its occurrences are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import stored

EDGE_SCHEMA = "node long, edge long, k1 long, k2 long, first int, last int, place int"


def repeated_occurrences(edges: DataFrame, name: str) -> DataFrame:
    """Edges whose node occurs at least twice, with ``copies`` (occurrences of the same edge) and ``branches``
    (distinct edges of the node).

    Node counts are combined map-side and joined back by node; only rows of repeated nodes go on.  A hot node
    is one row on the joined side, so its many occurrences can be split among tasks.
    """
    nodes = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    alive = stored(edges.join(nodes, "node", "left_semi"), f"{name}-alive")
    kinds = alive.groupBy("node", "edge").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "first")).alias("least")
    )
    branches = kinds.groupBy("node").agg(F.count(F.lit(1)).alias("branches"))
    kinds = stored(kinds.join(branches, "node"), f"{name}-kinds")
    return alive.join(kinds, ["node", "edge"])
