"""Connected components of a graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum over them, to see whether a round changed anything."""
    mixed = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    row = edges.agg(F.count("*"), F.sum(mixed)).first()
    return tuple(row)


def _to_smallest(edges: DataFrame) -> DataFrame:
    """Tie every node's larger neighbours to the smallest node it knows (large star)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller_together(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them (small star)."""
    down = edges.where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node each linked node can reach: ``node, component``.

    Each round writes its edges, so the lineage stays short and a lost executor
    costs one round at most; the number of rounds grows with the logarithm of a
    component's size. Rows of a hub are joined to one minimum per node, which
    adaptive execution splits; no task gathers a node's neighbours.

    Links with a null end or to the node itself say nothing and are left out.
    """
    edges = links.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    edges = cut_lineage(edges.distinct())
    before = None
    while True:
        now = _fingerprint(edges)
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        edges = cut_lineage(_smaller_together(cut_lineage(_to_smallest(edges))))
