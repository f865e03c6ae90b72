"""A table of buckets: last writes win, and only touched buckets are rewritten."""

import os

from pyspark.sql import functions as F

from corpusloom.sources import buckets, store

SCHEMA = "k string, v string, n long"


def folders(path):
    return {f"{d}/{b}" for d in os.listdir(f"{path}/data") for b in os.listdir(f"{path}/data/{d}") if b.startswith("bucket=")}


def test_merges_equal_the_log(spark, tmp_path):
    path = str(tmp_path / "table")
    assert buckets.current(spark, path, SCHEMA).count() == 0
    first = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 200).alias("k"), F.concat(F.lit("a"), "id").alias("v"), F.col("id").alias("n"))
    second = spark.createDataFrame([("k7", "new", 900), ("k8", "old", -1), (None, "null key", 1), ("k7", "newer", 901)], SCHEMA)
    assert len(buckets.merge(first, path, "k", ["n"], 16)) == 16
    before = folders(path)
    # The number of buckets is the table's own, whatever a later merge asks for.
    touched = buckets.merge(second, path, "k", ["n"], 4)
    assert 1 <= len(touched) <= 3 and len(folders(path) - before) == len(touched) and before <= folders(path)
    got = buckets.current(spark, path, SCHEMA)
    want = store.latest_version(first.unionByName(second), "k", ["n"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.v for r in got.where("k = 'k7' or k is null").collect()} == {"newer", "null key"}
    assert buckets.current(spark, path, SCHEMA, only=touched).count() < got.count()
    assert buckets.merge(second.limit(0), path, "k", ["n"]) == []
    assert buckets.vacuum(spark, path) == len(touched) and len(folders(path)) == 16
    assert buckets.current(spark, path, SCHEMA).count() == got.count() == 201
    # The same rows again change nothing.
    buckets.merge(second, path, "k", ["n"])
    assert sorted(map(tuple, buckets.current(spark, path, SCHEMA).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_merge_without_its_manifest_is_not_seen(spark, tmp_path):
    """Data that was written before the manifest's lines is no part of the table."""
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], SCHEMA)
    buckets.merge(rows, path, "k", ["n"], 2)
    rows.withColumn("v", F.lit("lost")).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/data/unfinished")
    assert {r.v for r in buckets.current(spark, path, SCHEMA).collect()} == {"x", "y"}
