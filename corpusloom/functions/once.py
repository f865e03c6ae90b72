"""Computing a costly column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """Add columns through a generator of one row.

    Projections and filters are not merged across a generator, so a costly
    expression is not copied into each of its uses.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [c for c in (df.columns if keep is None else keep) if c not in columns]
    return df.select(*kept, F.inline(packed))
