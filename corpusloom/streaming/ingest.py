"""Incremental ingestion with replay-safe batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.plans.ingest import current_chunks, document_chunks
from corpusloom.sources import store

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.parquet",
    schema: str = DOCUMENTS,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files that arrive in a folder, or one file, as a stream."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(where):
        folder, pattern = where.getParent().toString(), where.getName()
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_ingest(
    documents: DataFrame, log_path: str, checkpoint: str, metadata: Column | None = None, **sizes
) -> StreamingQuery:
    """Chunk a document stream into the chunk log.

    A micro-batch owns the folder of its number, so a replayed batch replaces
    what its first attempt wrote. Later arrivals win when the log is read;
    ``dropDuplicates`` on the stream would keep the first instead.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append_batch(document_chunks(batch, metadata, batch_id, **sizes), log_path, batch_id)

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_current(spark: SparkSession, log_path: str) -> DataFrame:
    return current_chunks(store.read_log(spark, log_path, store.CHUNKS))
