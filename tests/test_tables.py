"""Dealing out the rows of a table."""

import pyarrow as pa
import pyarrow.parquet as pq

from corpusloom.sources.tables import spread, table


def test_rows_of_one_large_group_are_dealt_out(spark, tmp_path):
    rows = pa.table({"k": list(range(4000)), "t": [f"text {i * i}" for i in range(4000)]})
    pq.write_table(rows, tmp_path / "one.parquet", compression="none")
    pq.write_table(rows, tmp_path / "many.parquet", compression="none", row_group_size=250)
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(8 << 10))
        one, many = table(spark, str(tmp_path), "one"), table(spark, str(tmp_path), "many")
        assert one.rdd.getNumPartitions() >= cores
        held = [len(p) for p in spread(one).rdd.glom().collect()]
        assert sum(held) == 4000 and max(held) < 2 * 4000 / cores
        assert sorted(r.k for r in spread(one).collect()) == list(range(4000)) and spread(one).columns == one.columns
        # Rows in many splits stay where they are.
        assert spread(many) is many
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
