"""Append-only Parquet logs with a last-write-wins view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNKS = (
    "doc_id long, chunk_index int, start_char int, end_char int, overlap_chars int, text string,"
    " metadata map<string,string>, chunk_id string, batch_id long"
)
ENTITIES = "entity_id string, name string, type string, description string, embedding array<float>, batch_id long"
RELATIONS = "source_id string, target_id string, type string, seq long, batch_id long"


def ensure(spark: SparkSession, path: str, schema: str) -> None:
    """Create an empty log unless one exists."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch_id").parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch into its own folder; writing it again replaces it."""
    df.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def latest_version(df: DataFrame, key: str, version: list[str | Column]) -> DataFrame:
    """The row written last per key.

    Every task trims its rows to one per key before the shuffle, however many
    copies a key has. Of rows with equal versions any one is taken.
    """
    stamps = [F.col(v) if isinstance(v, str) else v for v in version]
    last = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(v) for v in stamps])
    return df.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


def upsert(current: DataFrame, new: DataFrame, key: str, version: list[str | Column]) -> DataFrame:
    """Merge as a view: everything written, then the last row per key."""
    return latest_version(current.unionByName(new), key, version)


def compact(spark: SparkSession, path: str, schema: str, key: str, version: list[str], target: str) -> None:
    """Write the current rows of a log as a new log, and leave the old one.

    Readers move to ``target`` once it is whole; rows keep their batch, so
    later batches win over them as before.
    """
    rows = latest_version(read_log(spark, path, schema), key, version)
    rows.write.partitionBy("batch_id").parquet(target)
