"""Which requests of a log exceed a quota per client and minute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quota_flags(
    events: DataFrame,
    limit: int,
    unit: str = "minute",
    client: str = "user_id",
    ts: str = "ts",
    event: str = "event_id",
) -> DataFrame:
    """``over_limit`` for every event, in fixed windows per client.

    Only the first ``limit`` events of a window are ranked, and all but that
    many are trimmed before the shuffle. The last of them is the window's
    cut, which the other events are compared with, so a client that makes a
    large share of all requests is never sorted as one group.

    Requests without a client share one quota, as one client's would; those
    without a time share one window per client, in the order of their ids.
    """
    # Truncating turns a wall-clock time into an instant; turn it back.
    start = F.date_trunc(unit, F.col(ts)).cast(events.schema[ts].dataType)
    rows = events.select(event, client, ts, start.alias("window_start"))
    stamp = F.struct(F.col(ts), F.col(event))
    order = Window.partitionBy(client, "window_start").orderBy(ts, event)
    admitted = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    cuts = admitted.groupBy(client, "window_start").agg(F.max(stamp).alias("_cut"))
    cuts = cuts.withColumnsRenamed({client: "_client", "window_start": "_start"})
    same = rows[client].eqNullSafe(cuts["_client"]) & rows["window_start"].eqNullSafe(cuts["_start"])
    return rows.join(cuts, same).select(event, client, "window_start", (stamp > F.col("_cut")).alias("over_limit"))


def quota_counts(events: DataFrame, limit: int, lateness: str = "1 minute", client: str = "user_id", ts: str = "ts") -> DataFrame:
    """Requests per client and minute and how many were over the limit.

    Works on a stream (state is dropped once the watermark passes a window)
    and on a table alike. The time column is read as an instant.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    counts = (
        timed.withWatermark(ts, lateness).groupBy(F.window(ts, "1 minute"), F.col(client)).agg(F.count("*").alias("requests"))
    )
    return counts.select(
        client,
        F.col("window.start").alias("window_start"),
        "requests",
        F.greatest(F.col("requests") - F.lit(limit), F.lit(0)).alias("rejected"),
    )
