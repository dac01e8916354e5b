"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node of the component, other than itself) from links ``a, b``.

    Nodes that are least in their component are left out.  Every round links each node's larger neighbours to its
    least one, then its smaller neighbours to the least of them; the number of rounds grows with the
    logarithm of the longest chain.  Hot nodes are aggregated map-side and joined, never gathered.
    """
    edges = stored(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _state(edges)
        if after == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = after


class Forest:
    """Connected targets of one task: links of probes merge the targets they touch; between calls every label is a root."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)

    def join(self, probe: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Merge the targets of each probe (sorted by probe); the place of each probe's first link."""
        first = np.flatnonzero(np.diff(probe, prepend=-1))
        if not len(probe):
            return first
        run = np.cumsum(np.diff(probe, prepend=-1) != 0) - 1
        while True:
            self._compress()
            root = self.label[target]
            least = np.minimum.reduceat(root, first)[run]
            apart = root != least
            if not apart.any():
                return first
            # only roots are hooked, so that no target loses its former root
            np.minimum.at(self.label, root[apart], least[apart])

    def _compress(self) -> None:
        while ((up := self.label[self.label]) != self.label).any():
            self.label = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Targets that are not their own root, and their roots."""
        some = np.flatnonzero(self.label != np.arange(len(self.label)))
        return some, self.label[some]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
