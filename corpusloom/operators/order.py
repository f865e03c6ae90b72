"""Numbers for rows in a global order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage


def dense_order(rows: DataFrame, order: list[str], name: str = "ord", first: int = 0) -> DataFrame:
    """Add ``name``: ``first``, ``first + 1``, ... in the order of the given columns, nulls first.

    Range partitions are numbered on their own and shifted by the rows of those
    before, whose counts are one row per partition. The numbers are stored, so
    that they are the same in every use. Of rows equal in all order columns any comes first.
    """
    part = F.spark_partition_id()
    nth = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.select(F.struct(*rows.columns).alias("row"), part.alias("part"), nth.alias("nth")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(bases), "part").select("row.*", (F.col("base") + F.col("nth") + F.lit(first)).alias(name))
