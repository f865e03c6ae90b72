"""Exact duplicates by a 128-bit content hash with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, text_or_empty
from corpusloom.operators.sizing import broadcast_if_small
from corpusloom.session import cut_lineage


def content_hash(text: Column) -> Column:
    """128 bits, as bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hasher: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they have the same bytes after A-Z are lower-cased. Of
    equal texts the row with the smallest (or ``largest``) id stays.

    Only fixed-width rows pass the shuffles: hash groups are counted with a
    partial aggregate, so a hot text costs one row per task. Groups of several
    rows have their bytes compared by grouping on the text itself, again
    partially first; a hash that turns out to hold different texts is settled
    by text instead.

    Null texts count as empty. A null id never wins over another one. Rows that
    repeat an id with an equal text are all kept or all dropped; ``deduplicate``
    leaves one of them. An empty table gives no rows; other columns are ignored.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    best_by = {"smallest": F.min_by, "largest": F.max_by}[keep]
    norm = ascii_lower(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm")).withColumn("_hash", hasher(F.col("_norm")))
    keyed = cut_lineage(rows.select("doc_id", "_hash", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256")))

    per_id = keyed.groupBy("_hash", "doc_id").agg(F.count("*").alias("_n"))
    groups = per_id.groupBy("_hash").agg(
        F.sum("_n").alias("group_size"), pick("doc_id").alias("keep_id"), best_by("_n", "doc_id").alias("_copies")
    )
    several = cut_lineage(groups.where("group_size > 1"))

    marked = rows.join(broadcast_if_small(several.select("_hash")), "_hash", "left_semi")
    by_text = marked.groupBy("_hash", "_norm").agg(F.count("*").alias("_n"))
    collided = cut_lineage(by_text.groupBy("_hash").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_hash"))

    found = keyed.join(broadcast_if_small(several), "_hash", "left")
    if not collided.isEmpty():
        again = rows.join(broadcast_if_small(collided), "_hash", "left_semi")
        texts = (
            again.groupBy("_hash", "_norm", "doc_id")
            .agg(F.count("*").alias("_n"))
            .groupBy("_hash", "_norm")
            .agg(F.sum("_n").alias("group_size"), pick("doc_id").alias("keep_id"), best_by("_n", "doc_id").alias("_copies"))
        )
        settled = again.withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256)).join(texts, ["_hash", "_norm"])
        found = found.join(broadcast_if_small(collided), "_hash", "left_anti").unionByName(settled.drop("_norm"))
    lonely = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(lonely, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (lonely | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        F.coalesce("_copies", F.when(F.col("keep_id").isNull(), F.col("group_size")), F.lit(1)).alias("copies_of_kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents without exact copies, with all their columns.

    The verdicts are joined back on the id. Rows with a null id, and rows that
    share an id, are told apart by their text's hash.
    """
    verdicts = exact_duplicates(docs, id_col, text_col, keep)
    drop = cut_lineage(verdicts.where("not kept or copies_of_kept > 1").select("doc_id", "text_sha256", "kept").distinct())
    # Whole rows travel as one column, so that no name of theirs meets another.
    sha = F.sha2(ascii_lower(text_or_empty(text_col)).cast("binary"), 256)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), sha.alias("sha"))
    met = (F.col("sha") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("doc_id"))
    marked = rows.join(broadcast_if_small(drop), met, "left")
    alone = marked.where("kept is null").select("row.*")
    repeated = marked.where("kept").dropDuplicates(["sha", "id"]).select("row.*")
    return alone.unionByName(repeated)
