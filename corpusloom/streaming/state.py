"""Keyed state on streams: the last write per key, and admission under a quota.

Both keep what they must remember in the state store, so that a stream that is
stopped goes on where it was, and a batch that is replayed gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusloom.sources import store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Groups of clients whose events are judged together.
BUCKETS = 1024


def use_state_store(spark: SparkSession) -> None:
    """Streams that are started from here on keep their state in RocksDB, which these need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def last_writes(rows: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The rows of a stream that are newer than all earlier rows with their key, one per key and batch.

    Written to a log, the last of them per key is the current row; a row that
    comes late and is older is left out. Only the newest version is kept per
    key. Versions are compared column by column and are not null; a null key is a key.
    """
    schema = rows.schema
    names = [f.name for f in schema.fields]
    kept = T.StructType([schema[v] for v in version])

    class LastWrite(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.newest = handle.getValueState("newest", kept)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            best = None
            for part in rows:
                last = part.sort_values(version).tail(1)
                if best is None or tuple(last[version].iloc[0]) > tuple(best[version].iloc[0]):
                    best = last
            old = self.newest.get() if self.newest.exists() else None
            stamp = tuple(best[version].iloc[0])
            if old is None or stamp > tuple(old):
                self.newest.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in stamp))
                yield best[names]

        def close(self) -> None:
            pass

    grouped = rows.groupBy(key)
    return grouped.transformWithStateInPandas(statefulProcessor=LastWrite(), outputStructType=schema, outputMode="Update", timeMode="None")


def start_last_writes(rows: DataFrame, key: str, version: list[str], log_path: str, checkpoint: str) -> StreamingQuery:
    """Write :func:`last_writes` to a log; a batch that is replayed replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append_batch(batch, log_path, batch_id)

    return (
        last_writes(rows, key, version).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _filled(rows: DataFrame, name: str) -> Column:
    """The column with a value in place of nulls, so that whole numbers stay whole in pandas."""
    kind = rows.schema[name].dataType
    return F.coalesce(F.col(name), F.lit(0).cast(kind)) if isinstance(kind, (T.NumericType, T.StringType)) else F.col(name)


def admitted(
    events: DataFrame, limit: int, lateness: str = "1 minute", client: str = "user_id", ts: str = "ts", event: str = "event_id", buckets: int = BUCKETS
) -> DataFrame:
    """``over_limit`` for every event of a stream, as it comes: the first ``limit`` of a client's minute are admitted.

    Events of one batch are taken in the order of their time; a late event is judged by what came before it.
    Clients are dealt out to ``buckets`` by a hash, fixed for the life of a checkpoint. The events of one bucket in one
    batch are judged together, and the counts of its minutes are one value of the state, so calls to the
    state grow with the buckets and not with the events. The counts of a minute are forgotten when the
    watermark has passed it. The time column is read as an instant and is not null.
    """
    given = events.select(event, client, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, lateness)
    rows = given.select(
        _filled(given, event).alias("_event"),
        F.col(event).isNull().alias("_no_event"),
        _filled(given, client).alias("_client"),
        F.col(client).isNull().alias("_no_client"),
        (F.floor(F.unix_seconds(ts) / 60) * 60).cast("long").alias("_minute"),
        F.col(ts).alias("_ts"),
        F.pmod(F.xxhash64(client), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    columns, names = rows.columns, ["_event", "_no_event", "_client", "_no_client", "_minute"]
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("over_limit", T.BooleanType())])
    group = ["_client", "_no_client", "_minute"]

    class Quota(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.counts = handle.getValueState("counts", "held binary")

        def held(self) -> pd.DataFrame | None:
            return pa.ipc.open_stream(self.counts.get()[0]).read_pandas() if self.counts.exists() else None

        def keep(self, held: pd.DataFrame, timerValues) -> None:
            """Store what later batches may ask for: events up to the watermark do not come any more."""
            held = held[(held["_minute"] + 60) * 1000 > timerValues.getCurrentWatermarkInMs()]
            if not len(held):
                self.counts.clear()
                return
            table, sink = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            self.counts.update((sink.getvalue().to_pybytes(),))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # By place: the planner may name a column as before.
            found = pd.concat(list(rows), ignore_index=True).set_axis(columns, axis=1)
            found = found.sort_values(["_ts", "_no_event", "_event"], ignore_index=True)
            nth = found.groupby(group, sort=False, dropna=False).cumcount() + 1
            sizes = found.groupby(group, sort=False, dropna=False).size().rename("n").reset_index()
            old = self.held()
            if old is not None:
                before = found[group].merge(old, on=group, how="left")["n"].fillna(0)
                nth += before.to_numpy(dtype="int64")
                sizes = pd.concat([old, sizes]).groupby(group, sort=False, dropna=False)["n"].sum().reset_index()
            self.keep(sizes, timerValues)
            self.handle.registerTimer((int(sizes["_minute"].max()) + 60) * 1000)
            yield found[names].assign(over_limit=nth > limit)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            old = self.held()
            if old is not None:
                self.keep(old, timerValues)
            yield pd.DataFrame(columns=schema.names)

        def close(self) -> None:
            pass

    grouped = rows.groupBy("_bucket")
    judged = grouped.transformWithStateInPandas(statefulProcessor=Quota(), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return judged.select(
        F.when(~F.col("_no_event"), F.col("_event")).alias(event),
        F.when(~F.col("_no_client"), F.col("_client")).alias(client),
        F.timestamp_seconds("_minute").alias("window_start"),
        "over_limit",
    )
