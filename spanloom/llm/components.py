"""Connected components of links between ids, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut_lineage


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` joined to the least neighbour of ``u``.

    The least neighbours are checkpointed, so that both sides of the join are plain shuffles
    and adaptive execution can split the rows of a node with very many neighbours.
    """
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("least")))
    return edges.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node of ``links`` the smallest node it is connected to.

    Each round hooks larger neighbours to the least one, then flattens; a path of n nodes needs
    O(log^2 n) rounds.  Links with a null and self-links do not count; no links, no rows.
    """
    u, v = F.col("u"), F.col("v")
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .where((F.col(a) != F.col(b))).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        large = cut_lineage(_with_least(both).where(v > u)
                            .select(v.alias("u"), F.least(u, "least").alias("v")).distinct())
        small = _with_least(large)
        edges = cut_lineage(small.select("u", F.col("least").alias("v"))
                            .unionByName(small.where(v != F.col("least")).select(v.alias("u"), F.col("least").alias("v")))
                            .distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select(v.alias("node"), v.alias("root")).distinct()
    return edges.select(u.alias("node"), v.alias("root")).unionByName(roots)
