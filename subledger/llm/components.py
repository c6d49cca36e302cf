"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage

#: Edges (16 bytes each) that one task contracts without any shuffle; more are shuffled.
SMALL = 1_000_000


def _emit(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Each row's (u, v) pairs; unlike a union this keeps the partitioning of a single partition."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])))


def _lowest(e: DataFrame, small: bool) -> DataFrame:
    """(u, m): the least v of each u.  Written when edges are many, so that the join that
    follows stands alone in its stage and a node with very many edges can be split."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return low if small else stage(low, "components-low")


def _large_star(e: DataFrame, small: bool) -> DataFrame:
    """Connects the larger neighbours of each node to its least neighbour (or itself)."""
    both = _emit(e, ("u", "v"), ("v", "u"))
    low = _lowest(both, small)
    met = both.join(low.select("u", F.least("u", "m").alias("m")), "u").filter("v > u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, small: bool) -> DataFrame:
    """Connects each node and its smaller neighbours to the least of them."""
    met = e.join(_lowest(e, small), "u")
    return _emit(met, ("v", "m"), ("u", "m")).filter("u > v").distinct()


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Every round is a few joins of the edges with their nodes' minima, which are
    combined before any shuffle.  Contraction never adds edges, so their first
    count decides once whether a single task can hold them.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "components")
    few = e.count() <= small
    while True:
        part = e.coalesce(1) if few else e
        # done when every node has one edge and no edge ends in a node that has one
        above = part.groupBy("u").agg(F.count("*").alias("c"))
        if above.filter("c > 1").isEmpty() and part.select(F.col("v").alias("u")).join(above, "u", "left_semi").isEmpty():
            break
        nxt = stage(_small_star(_large_star(part, few), few), "components")
        drop_staged(e)
        e = nxt
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
