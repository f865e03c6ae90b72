"""Hashed n-gram counts as tables of fixed size, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runs of letters, and runs of anything else that is no white space.
TOKEN = r"\p{L}+|[^\p{L}\s]+"
BUCKETS = 1 << 16


def token_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def buckets_of(tokens: Column, grams: int = 1, buckets: int = BUCKETS) -> Column:
    """The buckets of all single tokens, and with ``grams`` of 2 also of all pairs of neighbours."""
    single = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    if grams == 1:
        return single
    places = F.when(F.size(tokens) > 1, F.sequence(F.lit(1), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(
        places, lambda i: F.pmod(F.xxhash64(F.get(tokens, i - 1), F.get(tokens, i)), F.lit(buckets)).cast("int")
    )
    return F.concat(single, pairs)


def dense(spark: SparkSession, table: DataFrame, value: Column, buckets: int = BUCKETS) -> Column:
    """One number per bucket as an array, as a scalar subquery; ``value`` is over ``table``'s columns, which
    are null for buckets that ``table`` lacks. Its size is that of ``buckets`` whatever the corpus."""
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(table, "bucket", "left")
    packed = F.sort_array(F.collect_list(F.struct("bucket", value.alias("v"))))
    return every.agg(F.transform(packed, lambda s: s["v"]).alias("values")).scalar()


def with_sums(rows: DataFrame, found: str, values: dict[str, Column]) -> DataFrame:
    """Add columns with the sum of the values of all buckets in the array ``found``.

    Rows look the values up in place: none is exploded, shuffled or joined.
    """
    held = rows.withColumns({f"_{name}": v for name, v in values.items()})

    def total(name: str) -> Column:
        return F.aggregate(found, F.lit(0.0), lambda total, b: total + F.get(F.col(f"_{name}"), b)).alias(name)

    return held.select(*rows.columns, *map(total, values))
