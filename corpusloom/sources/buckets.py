"""A last-write-wins table in buckets by key: an upsert rewrites the buckets it touches and no others.

Below a folder, ``data/<name>/bucket=<n>`` holds rows and ``manifest`` says which
folder is a bucket's current one. A merge writes new folders first and then
appends its lines to the manifest in one commit, so that readers see all of
it or nothing. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.store import latest_version

BUCKETS = 64
MANIFEST = "version long, bucket int, buckets int, folder string"


def _lines(spark: SparkSession, path: str) -> list:
    """The manifest's last line of each bucket; there are no more than buckets."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        return rows.groupBy("bucket", "buckets").agg(F.max("version").alias("version"), F.max_by("folder", "version").alias("folder")).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def current(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The rows of the table, or of the buckets named."""
    folders = [f"{path}/data/{r.folder}/bucket={r.bucket}" for r in _lines(spark, path) if only is None or r.bucket in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(new: DataFrame, path: str, key: str, version: list[str | Column], buckets: int = BUCKETS) -> list[int]:
    """Upsert rows by ``key``, the row with the highest ``version`` wins; returns the buckets that were rewritten.

    The first merge sets the number of buckets. Copies of a key are trimmed in
    every task before the shuffle, and a bucket is written by the task of its
    keys' partitions. A null key is a key.
    """
    spark, schema = new.sparkSession, new.schema
    lines = _lines(spark, path)
    buckets = lines[0].buckets if lines else buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = sorted(r.bucket for r in new.select(bucket.alias("bucket")).distinct().collect())
    if not touched:
        return []
    names = {r.bucket: r.folder for r in lines}
    old = [f"{path}/data/{names[b]}/bucket={b}" for b in touched if b in names]
    rows = spark.read.schema(schema).parquet(*old).unionByName(new) if old else new
    folder = uuid.uuid4().hex
    latest_version(rows, key, version).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    number = 1 + max((r.version for r in lines), default=0)
    entries = [(number, b, buckets, folder) for b in touched]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return touched


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete bucket folders that are no longer current; no reader may still use them."""
    held = {(r.folder, r.bucket) for r in _lines(spark, path)}
    every = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("folder", "bucket").distinct().collect()
    gone = 0
    for r in every:
        if (r.folder, r.bucket) not in held:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/{r.folder}/bucket={r.bucket}")
            gone += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
    return gone
