"""Joins for hot keys: broadcast what was measured to fit, else salt.

What does not fit must not be broadcast by Spark either, which guesses a frame's
size from its compressed files: such joins are asked to merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SALTS = 16
# Allowance per row for keys, scores and object headers.
ROW_OVERHEAD = 64


def broadcast_if_small(df: DataFrame, texts: list[str] = [], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised frame of narrow rows for broadcast if it fits.

    ``texts`` names the columns of unbounded length, which are measured.
    Beyond the limit the frame is marked for a merge join, which shuffles.
    """
    return F.broadcast(df) if fits(df, texts, limit) else df.hint("merge")


def fits(df: DataFrame, texts: list[str] = [], limit: int = BROADCAST_BYTES) -> bool:
    """Whether a frame of narrow rows was measured to be within the limit."""
    width = F.lit(ROW_OVERHEAD)
    for c in texts:
        width = width + F.coalesce(F.octet_length(c), F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] <= limit


def join_unique(
    rows: DataFrame,
    unique: DataFrame,
    key: str,
    salt_by: list[str],
    texts: list[str] = [],
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join to narrow rows that are unique in ``key``.

    One key may hold a large share of ``rows``. If the unique side does not
    fit a broadcast, it is repeated per salt, and the rows of a hot key are
    dealt out to that many tasks by the hash of ``salt_by``.
    """
    if fits(unique, texts, limit):
        return rows.join(F.broadcast(unique), key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    repeated = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [key, "_salt"]).drop("_salt")
