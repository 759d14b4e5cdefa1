"""Connected components of an undirected graph of long ids, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimworks.llm import _store


def _mins(rows: DataFrame) -> DataFrame:
    """u, v with the least of u and its v's; combined on the map side, so a hub costs one row a task."""
    least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return rows.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _mins(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges must run from the larger to the smaller id."""
    joined = _mins(edges)
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """The component of every id that occurs in edges(u, v).

    Returns id, component (the smallest id that can be reached). Nulls and loops are dropped,
    repeated edges count once, no edges give no rows. Each round is a table in the shared folder;
    rounds grow with the logarithm of the longest path. Raises if `most` rounds don't suffice.
    """
    edges = edges.filter("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, edges = None, _store.table(edges, "edges")
    for _ in range(most):
        last, edges = edges, _store.table(_small_star(_large_star(edges)), "edges")
        _store.discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        before = now
    raise RuntimeError(f"components have not converged in {most} rounds")
