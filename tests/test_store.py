import os
import shutil

from pyspark.sql import functions as F

from corpusloom.plans import ingest
from corpusloom.sources import store
from corpusloom.streaming import ingest as stream
from corpusloom.streaming import quota


def documents(spark, rows):
    return spark.createDataFrame(rows, stream.DOCUMENTS)


ROWS = [
    (1, "Same text.", "en", "a", 10),
    (2, "Other text. And more.", "en", "b", 21),
    (3, "Same text.", "de", "c", 10),
    (4, "", "en", "d", 0),
]


def test_last_write_wins(spark):
    meta = F.create_map(F.lit("source"), F.col("source"))
    got = {r.text: (r.doc_id, r.metadata["source"]) for r in ingest.chunk_store(documents(spark, ROWS), meta).collect()}
    assert got == {"Same text.": (3, "c"), "Other text. And more.": (2, "b")}


def test_ids_are_stable_and_batches_replace(spark, tmp_path):
    path = str(tmp_path / "log")
    store.ensure(spark, path, store.CHUNKS)
    first = ingest.document_chunks(documents(spark, ROWS), batch_id=0)
    for _ in range(2):
        store.append_batch(first, path, 0)
    once = store.read_log(spark, path, store.CHUNKS)
    assert once.count() == 3
    store.append_batch(ingest.document_chunks(documents(spark, ROWS[:1]), batch_id=1), path, 1)
    view = {r.text: r.batch_id for r in ingest.current_chunks(store.read_log(spark, path, store.CHUNKS)).collect()}
    assert view == {"Same text.": 1, "Other text. And more.": 0}
    store.ensure(spark, path, store.CHUNKS)
    assert store.read_log(spark, path, store.CHUNKS).count() == 4
    target = str(tmp_path / "compacted")
    store.compact(spark, path, store.CHUNKS, "chunk_id", ingest.ARRIVAL, target)
    small = store.read_log(spark, target, store.CHUNKS)
    assert small.count() == 2 and {r.text: r.batch_id for r in ingest.current_chunks(small).collect()} == view


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    inbox, log, state = (str(tmp_path / n) for n in ("inbox", "log", "state"))
    parts = [ROWS[:2], ROWS[2:], [(5, "Other text. And more.", "fr", "e", 21)]]
    for n, rows in enumerate(parts):
        documents(spark, rows).coalesce(1).write.mode("append").parquet(inbox)
        source = stream.document_stream(spark, inbox, files_per_batch=1)
        stream.start_ingest(source, log, state, F.create_map(F.lit("source"), F.col("source"))).awaitTermination()
    got = {r.text: r.doc_id for r in stream.read_current(spark, log).collect()}
    assert got == {"Same text.": 3, "Other text. And more.": 5}
    batches = sorted(d for d in os.listdir(log) if d.startswith("batch_id="))
    assert len(batches) >= 3
    # A batch that ran but was not committed runs again and replaces itself.
    again = str(tmp_path / "state-2")
    shutil.copytree(state, again)
    last = max(int(f) for f in os.listdir(f"{again}/commits") if f.isdigit())
    for f in (f"{again}/commits/{last}", f"{again}/commits/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)
    before = store.read_log(spark, log, store.CHUNKS).count()
    source = stream.document_stream(spark, inbox, files_per_batch=1)
    stream.start_ingest(source, log, again, F.create_map(F.lit("source"), F.col("source"))).awaitTermination()
    assert store.read_log(spark, log, store.CHUNKS).count() == before


EVENTS = "event_id long, user_id long, ts timestamp_ntz"


def events(spark):
    rows = []
    n = 0
    for user, minute, count in [(1, 0, 5), (1, 1, 2), (2, 0, 3), (3, 7, 9)]:
        for i in range(count):
            rows.append((n, user, f"2024-01-01 00:{minute:02d}:{(i * 7) % 60:02d}"))
            n += 1
    return spark.createDataFrame(rows, "event_id long, user_id long, s string").select(
        "event_id", "user_id", F.col("s").cast("timestamp_ntz").alias("ts")
    )


def test_quota_flags_count_from_the_first(spark):
    got = quota.quota_flags(events(spark), 3)
    over = {(r.user_id, str(r.window_start)[14:16]): r.n for r in got.where("over_limit").groupBy("user_id", "window_start").agg(F.count("*").alias("n")).collect()}
    assert got.count() == 19 and over == {(1, "00"): 2, (3, "07"): 6}


def test_quota_counts_on_a_stream(spark, tmp_path):
    inbox = str(tmp_path / "events")
    events(spark).write.parquet(inbox)
    source = spark.readStream.schema(EVENTS).parquet(inbox)
    query = (
        quota.quota_counts(source, 3).writeStream.format("memory").queryName("quota_test").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.sql("select user_id, requests, rejected from quota_test").collect())
    assert got == [(1, 2, 0), (1, 5, 2), (2, 3, 0), (3, 9, 6)]


def test_cut_tables_can_be_dropped(spark):
    from corpusloom import session

    before = list(session._cuts)
    session._cuts.clear()
    try:
        cut = session.cut_lineage(spark.range(5).withColumnRenamed("id", "n"))
        path = session._cuts[0]
        assert cut.count() == 5 and path.startswith(session.shared_dir(spark)) and os.path.isdir(path)
        assert session.drop_cuts(spark) == 1 and not os.path.exists(path)
    finally:
        session._cuts[:] = before


def test_requests_without_client_or_time_are_judged_too(spark):
    rows = [(1, None, "2024-01-01 00:00:01"), (2, None, "2024-01-01 00:00:02"), (3, 7, None), (4, 7, None), (5, None, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.event_id: r.over_limit for r in quota.quota_flags(df, 1).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_last_write_needs_no_aggregate_over_rows(spark):
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", None), (None, "n", 1)], "k string, v string, n long")
    rows = store.latest_version(log, "k", ["n"])
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect()), key=str) == [("a", "y", 2), ("b", "z", None), (None, "n", 1)]
