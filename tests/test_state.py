"""Keyed state on streams that stop, go on and replay."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.checks import inputs
from corpusloom.sources import store
from corpusloom.streaming import ingest as stream
from corpusloom.streaming import quota, state

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, v string"


def events(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, s string, v string")
    return df.select("event_id", "user_id", F.col("s").cast("timestamp_ntz").alias("ts"), "v")


@pytest.fixture
def inbox(spark, tmp_path):
    state.use_state_store(spark)
    path = str(tmp_path / "in")

    def arrive(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(SCHEMA).parquet(path)

    yield arrive
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_last_write_per_key(spark, tmp_path, inbox):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "state")
    parts = [
        [(1, 7, "2024-01-01 00:00:05", "a"), (2, 7, "2024-01-01 00:00:09", "b"), (3, 8, "2024-01-01 00:00:01", "c"), (4, None, "2024-01-01 00:00:01", "n")],
        [(5, 7, "2024-01-01 00:00:07", "late"), (6, 8, "2024-01-01 00:00:01", "d")],
        [(7, 7, "2024-01-02 00:00:00", "e")],
    ]
    for rows in parts:
        state.start_last_writes(inbox(rows), "user_id", ["ts", "event_id"], log, checkpoint).awaitTermination()
    written = spark.read.parquet(log)
    assert sorted(r.v for r in written.collect()) == ["b", "c", "d", "e", "n"]
    got = {r.user_id: r.v for r in store.latest_version(written, "user_id", ["ts", "event_id"]).collect()}
    assert got == {7: "e", 8: "d", None: "n"}


def test_quota_counts_go_on_over_batches(spark, tmp_path, inbox):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    at = lambda minute, second: f"2024-01-01 00:{minute:02d}:{second:02d}"
    parts = [
        [(1, 7, at(0, 1), ""), (2, 7, at(0, 2), ""), (3, 8, at(0, 3), "")],
        [(4, 7, at(0, 30), ""), (5, 8, at(0, 40), ""), (6, 7, at(1, 0), "")],
        [(7, 7, at(9, 0), ""), (8, 8, at(9, 59), ""), (9, 8, at(9, 58), ""), (10, 8, at(9, 57), "")],
    ]
    for rows in parts:
        query = (
            state.admitted(inbox(rows), 2).writeStream.format("parquet").option("path", target)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = {r.event_id: r.over_limit for r in spark.read.parquet(target).collect()}
    whole = quota.quota_flags(events(spark, [r for p in parts for r in p]), 2)
    assert got == {r.event_id: r.over_limit for r in whole.collect()}
    assert sorted(k for k, over in got.items() if over) == [4, 8]


def test_documents_stream_from_a_file_and_a_folder(spark, folder, tmp_path):
    table = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30")
    parts = str(tmp_path / "documents.parquet")
    table.repartition(3).write.parquet(parts)
    one = str(tmp_path / "one")
    table.coalesce(1).write.parquet(one)
    file = next(f for f in os.listdir(one) if f.endswith(".parquet"))
    found = []
    for n, path in enumerate((parts, f"{one}/{file}")):
        log = str(tmp_path / f"log{n}")
        source = stream.document_stream(spark, path, files_per_batch=1)
        stream.start_ingest(source, log, str(tmp_path / f"state{n}")).awaitTermination()
        found.append(sorted(r.chunk_id for r in stream.read_current(spark, log).collect()))
    assert found[0] == found[1] and len(found[0]) > 30


def test_arrivals_are_the_whole_table(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (2,), (5,), (9,)], "n long")
    parts = [[r.n for r in p.collect()] for p in inputs.arrivals(df, "n")]
    assert sorted(x or 0 for p in parts for x in p) == [0, 1, 1, 2, 5, 9] and len(parts) == 3
    assert all(max(x or 0 for x in a) < min(b) for a, b in zip(parts, parts[1:]) if b)
    assert sum(p.count() for p in inputs.arrivals(df.limit(0), "n")) == 0


def test_quota_calls_the_state_per_bucket(spark, tmp_path, inbox):
    """Many clients, some without an id, ids beyond 2^53 and a stop: judged in few buckets as one after the other."""
    big, target, checkpoint = 1 << 60, str(tmp_path / "out"), str(tmp_path / "state")
    rows = [(big + i if i % 9 else None, None if i % 7 == 0 else big + i % 3, f"2024-01-01 00:00:{i:02d}", "") for i in range(40)]
    for part in (rows[:25], rows[25:]):
        query = (
            state.admitted(inbox(part), 3, buckets=2).writeStream.format("parquet").option("path", target)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        # Keys that were updated, over the batches of one start: not one per client and minute.
        assert all(p["stateOperators"][0]["numRowsUpdated"] <= 2 * 2 for p in query.recentProgress)
    seen, want = {}, []
    for event, client, _, _ in rows:
        seen[client] = seen.get(client, 0) + 1
        want.append((event, client, seen[client] > 3))
    got = [(r.event_id, r.user_id, r.over_limit) for r in spark.read.parquet(target).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
