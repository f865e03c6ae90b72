"""Answering batches of questions from chunks and the entity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import extraction, graph, similarity
from corpusloom.operators.sizing import broadcast_if_small
from corpusloom.session import cut_lineage

DEFAULT_LIMIT = 5


def hit_payload(hits: DataFrame, text: str = "text", metadata: str = "metadata") -> DataFrame:
    """Hits as ``text`` (never null), ``score`` and ``metadata`` with the text."""
    shown = F.coalesce(F.col(text), F.lit(""))
    kept = F.map_filter(
        F.coalesce(F.col(metadata), F.expr("cast(map() as map<string,string>)")), lambda k, v: k != F.lit("text")
    )
    return hits.withColumn(text, shown).withColumn(metadata, F.map_concat(kept, F.create_map(F.lit("text"), shown)))


def source_label(metadata: Column) -> Column:
    """File name, else source, else a fixed label."""
    return F.coalesce(
        F.nullif(metadata["filename"], F.lit("")),
        F.nullif(metadata["source"], F.lit("")),
        F.lit("Unknown Source"),
    )


def score_label(score: Column) -> Column:
    """The score with two decimals."""
    return F.format_string("%.2f", score)


def topk_chunks(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_LIMIT, limits=similarity.Limits()) -> DataFrame:
    """Ranked hits with their text and metadata.

    ``queries`` may ask for a number of hits each, in a column ``limit``; where
    it is null or missing, ``k`` holds. The search reads ids and vectors only.
    Afterwards the hits, if they are few, go to the chunks, so that the store is
    scanned and not shuffled.
    """
    if "limit" in queries.columns:
        wanted = queries.select("query_id", F.coalesce("limit", F.lit(k)).alias("_limit"))
        most = wanted.agg(F.coalesce(F.max("_limit"), F.lit(k))).first()[0]
        hits = similarity.topk(queries, chunks, most, limits=limits).join(wanted, "query_id").where("rank <= _limit").drop("_limit")
    else:
        hits = similarity.topk(queries, chunks, k, limits=limits)
    hits = cut_lineage(hits)
    return chunks.select("chunk_id", "text", "metadata").join(broadcast_if_small(hits, ["chunk_id"]), "chunk_id")


def context_text(hits: DataFrame) -> DataFrame:
    """The hits of each query in rank order, as ``context[]`` with text, score and metadata, and their joined texts."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "text", "score", F.map_entries("metadata").alias("m"))))
    shown = F.transform(
        rows,
        lambda r: F.struct(r["text"].alias("text"), r["score"].alias("score"), F.map_from_entries(r["m"]).alias("metadata")),
    )
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("context_text"),
        shown.alias("context"),
        F.count("*").alias("num_hits"),
        F.max("score").alias("best_score"),
    )


def hybrid_query(
    queries: DataFrame,
    chunks: DataFrame,
    entities: DataFrame,
    edges: DataFrame,
    k: int = DEFAULT_LIMIT,
    entry_limit: int = graph.ENTRY_LIMIT,
    entry_threshold: float = graph.ENTRY_THRESHOLD,
    limits=similarity.Limits(),
) -> DataFrame:
    """Queries with context, graph summary and the prompt to send.

    ``queries(query_id, query, embedding)``, and maybe ``limit``; every query
    keeps its row. ``context`` has its hits, null if it has none.
    """
    context = context_text(topk_chunks(queries, chunks, k, limits))
    entries = graph.entry_points(queries, entities, entry_limit, entry_threshold, limits)
    summary = graph.graph_context(queries, entries, entities, edges)
    joined = (
        queries.select("query_id", "query")
        .join(context, "query_id", "left")
        .join(summary, "query_id", "left")
        .fillna({"context_text": "", "graph_summary": "", "num_hits": 0})
    )
    return extraction.answer_prompts(joined)
