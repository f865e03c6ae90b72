"""Expressions and batch helpers the operators of this subpackage share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six characters that separate words.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

# How much text one step in a Python worker takes up at once.
BATCH_BYTES = 4 << 20


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; other letters stay as they are.

    ``lower`` does the same where every character is one byte, and is much faster there.
    """
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(c: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(c, SPACE_CLASS + "+"), lambda w: w != "")


def id_remainder(c: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of text, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, to - at)
            done, at = int(ends[to - 1]), to


def running_base(totals: DataFrame, part: str, count: str) -> DataFrame:
    """Per part the sum of ``count`` over all smaller parts, as ``base``.

    ``totals`` has one row per part: its size is the number of tasks or groups, not of rows.
    """
    from pyspark.sql import Window

    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias("base"))


def dense_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 0 in the given order, without gaps; of equal ones any comes first."""
    from corpusloom.session import cut_lineage

    part = F.spark_partition_id()
    nth = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.select("*", part.alias("_part"), nth.alias("_nth")))
    base = running_base(placed.groupBy("_part").agg(F.count("*").alias("n")), "_part", "n")
    return placed.join(F.broadcast(base), "_part").select(*rows.columns, (F.col("base") + F.col("_nth")).alias(name))
