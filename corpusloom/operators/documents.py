"""Documents to sentences, chunks, blocks and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.once import compute_once

PAGE_BREAK = "\n\n---PAGE BREAK---\n\n"


def whole_text_chunks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Raw text as one chunk per row: it is stored as given, not split."""
    return df.select(
        key,
        F.lit(0).alias("chunk_index"),
        F.lit(0).alias("start_char"),
        F.length(text).alias("end_char"),
        F.col(text).alias("text"),
        *[c for c in df.columns if c not in (key, text)],
    )


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(tx.sentence_array(F.col(text))).alias("pos", "sentence"))


def chunks(
    df: DataFrame,
    text: str = "text",
    size: int = tx.CHUNK_SIZE,
    overlap: int = tx.CHUNK_OVERLAP,
) -> DataFrame:
    """Sentence-aware overlapping chunks; the other columns are carried along.

    Offsets are nominal: ``start_char`` advances by the chunk length less the
    overlapping sentences, in a text whose whitespace is one space.
    """
    carried = [c for c in df.columns if c != text]
    return df.select(
        *carried, F.posexplode(tx.chunk_array(F.col(text), size, overlap)).alias("chunk_index", "c")
    ).select(
        *carried,
        "chunk_index",
        F.col("c.start").alias("start_char"),
        (F.col("c.start") + F.length("c.text")).alias("end_char"),
        F.col("c.overlap").alias("overlap_chars"),
        F.col("c.text").alias("text"),
    )


def chunk_metadata(chunk_rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Document metadata on every chunk, with its ``chunk_index``."""
    own = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    kept = F.map_filter(F.col(metadata), lambda k, v: k != F.lit("chunk_index"))
    return chunk_rows.withColumn(metadata, F.map_concat(kept, own))


def document_metadata(**columns: Column) -> Column:
    """``map<string,string>`` of the given columns."""
    return F.create_map(*[part for k, c in columns.items() for part in (F.lit(k), c.cast("string"))])


def text_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = tx.BLOCK_SIZE) -> DataFrame:
    return df.select(key, F.posexplode(tx.block_array(F.col(text), size)).alias("block_index", "block"))


def reassemble_text(chunk_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One text per document from its chunks in order; overlaps repeat."""
    return join_ordered(chunk_rows, [key], ["chunk_index"], "\n\n", "full_text")


def join_ordered(df: DataFrame, keys: list[str], order: list[str], sep: str, name: str, text: str = "text") -> DataFrame:
    """Ordered string aggregate; the result is one value per key by nature."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias(name))


def rejoined_text(documents: DataFrame, key: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """The same as :func:`reassemble_text`, straight from the documents.

    A document's chunks come from one row, so nothing has to be shuffled.
    """
    pieces = F.transform(tx.chunk_array(F.col(text), **sizes), lambda c: c["text"])
    joined = compute_once(documents, [key], full_text=F.array_join(pieces, "\n\n"))
    return joined.where(F.col("full_text") != "")


def doc_stats(documents: DataFrame, key: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """Chunks and characters per document, counted within its row.

    ``documents`` carries ``filename``, ``file_type`` and ``num_pages``.
    """
    carried = [c for c in documents.columns if c not in (key, text)]
    return documents.select(
        key,
        *carried,
        F.size(tx.chunk_array(F.col(text), **sizes)).cast("long").alias("num_chunks"),
        F.length(text).alias("total_characters"),
    )


def ingest_summary(stats: DataFrame, group: str) -> DataFrame:
    """Per source: units (pages, documents) processed and chunks made.

    ``stats`` has one row per unit with its ``num_chunks``.
    """
    return stats.groupBy(group).agg(
        F.count("*").alias("processed"),
        F.sum("num_chunks").alias("num_chunks"),
        F.lit("success").alias("status"),
    )


def duplicate_report(chunk_rows: DataFrame, order: list[str]) -> DataFrame:
    """Copies per content id, with the first and last arrival as ``first_`` and ``last_`` of the order columns."""
    place = F.struct(*order)
    seen = chunk_rows.groupBy("chunk_id").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max(place).alias("last"))
    return seen.select("chunk_id", "copies", *[F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in order])


def chunk_offsets(chunk_rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Start offsets recomputed as running sums of lengths less overlaps."""
    sizes = compute_once(chunk_rows, [key, "chunk_index", "overlap_chars"], _chars=F.length(text))
    order = Window.partitionBy(key).orderBy("chunk_index")
    before = F.sum("_chars").over(order.rowsBetween(Window.unboundedPreceding, -1))
    shared = F.sum("overlap_chars").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select(
        key, "chunk_index", "overlap_chars", (F.coalesce(before, F.lit(0)) - shared).alias("start_char")
    )
