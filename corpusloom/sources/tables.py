"""Loading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """One task per core for a table whose rows come in fewer splits than that.

    Meant for costly text work on small inputs, and on files of few row groups: a
    split has the groups whose middles lie in it, so most splits of such a file have no
    rows. A table with rows in many splits is left as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores)
    # Reads no column. Rows are dealt out by their number, since to deal them out in turn Spark would sort them first.
    if df.select(F.spark_partition_id().alias("split")).distinct().count() >= cores:
        return df
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(splits, "_row").drop("_row")
