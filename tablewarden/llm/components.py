"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.session import stage


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with the smallest neighbour of its `u`.

    The minima are written down first: then both sides of the join come from exchanges of their own,
    and Spark can split the edges of a node that has very many of them.
    """
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`; a component is its smallest node.

    Alternates two steps until all edges lead to a smallest node: every node's larger neighbours
    are tied to the smallest node it knows, then its smaller ones are. Each round is a fixed number
    of joins over the edges, and rounds grow with the logarithm of the longest path. Edges with a
    null end or equal ends are ignored; no edges give no rows.
    """
    now = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    while not _is_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both)
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        large = stage(large, "edges")
        tied = _with_least(large)
        now = stage(
            tied.select(
                F.explode(
                    F.array(
                        F.struct(F.col("u"), F.col("m").alias("v")),
                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    )
                ).alias("e")
            )
            .select("e.*")
            .where("u != v")
            .distinct(),
            "edges",
        )
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _is_stars(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and that one has none."""
    nodes = edges.groupBy("u").agg(F.count("*").alias("n"))
    ends = edges.select(F.col("v").alias("u")).distinct()
    twice = nodes.where("n > 1").select("u")
    return twice.union(nodes.join(ends, "u", "left_semi").select("u")).isEmpty()
