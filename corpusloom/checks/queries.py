"""The registered queries: one per operator, over whole tables.

Arrays and maps are rendered as text and floating values rounded, so that a
result can be compared value by value with its SQL.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.checks import inputs
from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.operators import cells
from corpusloom.operators import documents as docs
from corpusloom.operators import embedding as emb
from corpusloom.operators import extraction, fitted, graph, resolution, similarity
from corpusloom.plans import ingest, retrieve
from corpusloom.session import cut_lineage, scratch_path
from corpusloom.sources import buckets, files, store, web
from corpusloom.sources.tables import spread, table
from corpusloom.streaming import ingest as stream
from corpusloom.streaming import quota, state

PAIR_THRESHOLD = 0.30
RESOLVE_THRESHOLD = 0.35
GRAPH_THRESHOLD = 0.92
ENTRY_THRESHOLD = 0.20
CELL_PROBES = 12
# The order in which lines of orders arrive.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]
CRAWL_DEPTH = 2
CRAWL_PAGES = 100
CRAWL_LIMIT = 5
# Depth and pages that reach every page of a site.
WHOLE_DEPTH = 6
WHOLE_PAGES = inputs.SITE_PAGES
QUOTA = 1
# What a model's response belongs to.
BLOCK_KEYS = ["doc_id", "block_index"]
BANDS = similarity.SignBands.for_recall(PAIR_THRESHOLD, recall=0.95, bits=4)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(f: Query) -> Query:
    """Register a query; its integers are widened, as SQL engines differ there."""

    @functools.wraps(f)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = f(spark, sf)
        return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])

    REGISTRY[f.__name__] = query
    return query


def _score(c: str = "score") -> Column:
    return F.round(c, 6).alias("score")


def _vector_text(c: str) -> Column:
    """Components in units of 1e-4, as one text."""

    def units(x: Column) -> Column:
        # As round does, which goes through decimal digits.
        half_up = F.floor(F.abs(x.cast("double") * 10000) + 0.5)
        return F.when(x < 0, -half_up).otherwise(half_up).cast("string")

    return F.array_join(F.transform(c, units), ",")


def _documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def _pages(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "pages"))


def _chunks(spark, sf) -> DataFrame:
    return docs.chunks(_documents(spark, sf).select("doc_id", "text"))


def _log(spark, sf) -> DataFrame:
    """Two arrivals: every document, then those that have a label, again."""
    first = ingest.document_chunks(_documents(spark, sf), inputs.metadata(), 0)
    labelled = _documents(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return first.unionByName(ingest.document_chunks(labelled, inputs.metadata(), 1))


# ------------------------------------------------------ sources and sinks


@register
def ingest_text(spark, sf):
    rows = docs.whole_text_chunks(_documents(spark, sf).select("doc_id", "text", "source"))
    return rows.select(
        "doc_id", "chunk_index", "start_char", "end_char", "source", tx.content_id(F.col("text")).alias("chunk_id")
    )


@register
def ingest_files_filter(spark, sf):
    return files.admit(inputs.uploads(spark, sf))


@register
def page_text(spark, sf):
    return web.page_text(_pages(spark, sf))


@register
def page_main_text(spark, sf):
    return web.main_content(_pages(spark, sf))


@register
def page_markdown(spark, sf):
    return web.page_markdown(_pages(spark, sf))


@register
def ingest_files(spark, sf):
    return ingest.file_chunks(inputs.stored_files(spark, sf))


@register
def page_records(spark, sf):
    return web.page_records(inputs.site(spark, sf))


@register
def chunk_upsert(spark, sf):
    return ingest.current_chunks(_log(spark, sf)).select(
        "chunk_id",
        "doc_id",
        "chunk_index",
        "start_char",
        "end_char",
        "batch_id",
        "text",
        F.col("metadata")["filename"].alias("filename"),
        F.col("metadata")["chunk_index"].alias("meta_index"),
    )


@register
def chunk_merge(spark, sf):
    """The same two arrivals, merged into a table of buckets one after the other."""
    path = scratch_path(spark, "chunk-table")
    log = _log(spark, sf)
    for batch in (0, 1):
        buckets.merge(log.where(F.col("batch_id") == batch), path, "chunk_id", ingest.ARRIVAL)
    rows = buckets.current(spark, path, log.schema)
    return rows.select(
        "chunk_id", "doc_id", "chunk_index", "start_char", "end_char", "batch_id", "text",
        F.col("metadata")["filename"].alias("filename"), F.col("metadata")["chunk_index"].alias("meta_index"),
    )


def _entity_versions(spark, sf):
    """Suppliers written once, and again in the order of their lines."""
    none = F.lit(0).cast("long")
    first = inputs.entities(spark, sf).select("*", *[none.alias(c) for c in LINE_ORDER])
    again = (
        table(spark, sf, "lineitem")
        .select(
            F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("entity_id"),
            F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("name"),
            F.lit("supplier").alias("type"),
            F.concat(F.lit("last sold part "), F.col("l_partkey").cast("string")).alias("description"),
            *[F.col(c).cast("long").alias(c) for c in LINE_ORDER],
        )
    )
    return first, again


@register
def entity_upsert(spark, sf):
    first, again = _entity_versions(spark, sf)
    return store.upsert(first, again, "entity_id", LINE_ORDER)


@register
def entity_lookup(spark, sf):
    asked = table(spark, sf, "part").select(
        F.concat(F.lit("part/"), (F.col("p_partkey") * 2).cast("string")).alias("entity_id")
    )
    return graph.lookup(asked, inputs.entities(spark, sf))


@register
def entity_payload_update(spark, sf):
    totals = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    updates = totals.select(
        F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("entity_id"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("sold "), F.col("n").cast("string"))).alias("description"),
    )
    return graph.update_payload(inputs.entities(spark, sf), updates)


# ------------------------------------------------------------------- text


@register
def sentences(spark, sf):
    return docs.sentences(_documents(spark, sf))


@register
def chunks(spark, sf):
    return _chunks(spark, sf)


@register
def chunk_metadata(spark, sf):
    rows = docs.chunks(_documents(spark, sf).select("doc_id", "text", inputs.metadata().alias("metadata")))
    m = F.col("metadata")
    return docs.chunk_metadata(rows).select(
        "doc_id",
        "chunk_index",
        m["filename"].alias("filename"),
        m["source"].alias("source"),
        m["lang"].alias("lang"),
        m["chunk_index"].alias("meta_index"),
    )


@register
def text_blocks(spark, sf):
    return docs.text_blocks(_documents(spark, sf))


@register
def reassemble_text(spark, sf):
    return docs.rejoined_text(_documents(spark, sf))


@register
def chunk_ids(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_index", tx.content_id(F.col("text")).alias("chunk_id"))


@register
def embed_text(spark, sf):
    rows = emb.embed_text(_chunks(spark, sf).select("doc_id", "chunk_index", "text"), loader=emb.gram_hashing(64))
    return rows.select("doc_id", "chunk_index", _vector_text("embedding").alias("embedding"))


@register
def embed_text_fitted(spark, sf):
    """Chunks embedded by axes fitted on all of them: iterative, and so without SQL."""
    chunks = cut_lineage(_chunks(spark, sf).select("doc_id", "chunk_index", "text"))
    rows = emb.embed_text(chunks, loader=fitted.embedder(fitted.fit(chunks, dim=64)))
    return rows.select("doc_id", "chunk_index", _vector_text("embedding").alias("embedding"))


@register
def entity_text(spark, sf):
    return inputs.entities(spark, sf).select(
        "entity_id", emb.entity_text(F.col("name"), F.col("description")).alias("entity_text")
    )


@register
def extraction_prompts(spark, sf):
    rows = ingest.block_prompts(_documents(spark, sf))
    m = F.col("messages")
    return rows.select(
        "doc_id",
        "block_index",
        m[0]["role"].alias("first_role"),
        m[0]["content"].alias("rules"),
        m[1]["role"].alias("second_role"),
        m[1]["content"].alias("content"),
    )


@register
def approx_tokens(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", tx.approx_tokens(F.col("text")).alias("tokens"))


def _parsed(spark, sf):
    return extraction.parse_extractions(inputs.responses(spark, sf))


@register
def parse_extractions(spark, sf):
    rows = lambda c, *names: F.array_join(
        F.transform(c, lambda e: F.concat_ws("|", *[e[n] for n in names])), ";"
    )
    return _parsed(spark, sf).select(
        *BLOCK_KEYS,
        "valid",
        F.size("entities").cast("long").alias("num_entities"),
        F.size("relations").cast("long").alias("num_relations"),
        rows("entities", "name", "type", "description").alias("entities"),
        rows("relations", "source", "target", "type").alias("relations"),
    )


@register
def malformed_relations(spark, sf):
    return _parsed(spark, sf).where("dropped > 0").select(*BLOCK_KEYS, F.col("dropped").cast("long").alias("dropped"))


# ---------------------------------------------------------------- vectors


@register
def similarity_join(spark, sf):
    rows = similarity.similar_pairs(table(spark, sf, "embeddings"), PAIR_THRESHOLD)
    return rows.select(F.col("id_a").alias("vec_a"), F.col("id_b").alias("vec_b"), _score())


@register
def similarity_join_tiled(spark, sf):
    """The same join with both sides cut into tiles."""
    tiles = similarity.Limits(broadcast_rows=0, tile_rows=128, pivots=8)
    rows = similarity.similar_pairs(table(spark, sf, "embeddings"), PAIR_THRESHOLD, limits=tiles)
    return rows.select(F.col("id_a").alias("vec_a"), F.col("id_b").alias("vec_b"), _score())


@register
def similarity_join_lsh(spark, sf):
    rows = similarity.similar_pairs_banded(table(spark, sf, "embeddings"), PAIR_THRESHOLD, BANDS)
    return rows.select(F.col("id_a").alias("vec_a"), F.col("id_b").alias("vec_b"), _score())


@register
def score_threshold(spark, sf):
    rows = similarity.similarity_join(
        inputs.label_centres(spark, sf), table(spark, sf, "embeddings"), PAIR_THRESHOLD, right_id="vec_id"
    )
    return rows.select("query_id", "vec_id", _score())


def _centre_hits(spark, sf, k, threshold=None):
    return similarity.topk(
        inputs.label_centres(spark, sf), table(spark, sf, "embeddings"), k, threshold, corpus_id="vec_id"
    )


@register
def topk_entities(spark, sf):
    return _centre_hits(spark, sf, 3, PAIR_THRESHOLD).select("query_id", "rank", "vec_id", _score())


@register
def topk_in_cells(spark, sf):
    """Every vector's nearest three by cells: approximate, and so without SQL."""
    corpus = table(spark, sf, "embeddings")
    centres = cells.train_cells(corpus, id_="vec_id")
    lists = cut_lineage(cells.cell_lists(corpus, centres, id_="vec_id"))
    asked = corpus.select(F.col("vec_id").alias("query_id"), "embedding")
    rows = cells.topk_in_cells(asked, lists, centres, 3, CELL_PROBES, corpus_id="vec_id")
    return rows.select("query_id", "rank", "vec_id", _score())


@register
def nearest_entity_tiled(spark, sf):
    tiles = similarity.Limits(broadcast_rows=0, tile_rows=128, pivots=8)
    rows = similarity.nearest(
        inputs.label_centres(spark, sf), table(spark, sf, "embeddings"), RESOLVE_THRESHOLD, corpus_id="vec_id", limits=tiles
    )
    return rows.select("query_id", "vec_id", _score())


@register
def nearest_entity(spark, sf):
    rows = similarity.nearest(
        inputs.label_centres(spark, sf), table(spark, sf, "embeddings"), RESOLVE_THRESHOLD, corpus_id="vec_id"
    )
    return rows.select("query_id", "vec_id", _score())


def _store(spark, sf):
    """Current chunks with vectors: each distinct text is embedded once."""
    current = ingest.chunk_store(_documents(spark, sf), inputs.metadata())
    return emb.embed_text(current.select("chunk_id", "text", "metadata"), loader=emb.gram_hashing(inputs.DIM))


@register
def ingest_documents(spark, sf):
    rows = ingest.ingest_documents(_documents(spark, sf), inputs.metadata(), emb.gram_hashing(inputs.DIM))
    m = F.col("metadata")
    return rows.select("chunk_id", "doc_id", "chunk_index", m["source"].alias("source"), "text", _vector_text("embedding").alias("embedding"))


@register
def ingest_urls(spark, sf):
    starts, pages = inputs.site_starts(spark, sf), inputs.site(spark, sf)
    rows = ingest.ingest_urls(starts, pages, WHOLE_PAGES, WHOLE_DEPTH, emb.gram_hashing(inputs.DIM))
    m = F.col("metadata")
    return rows.select(
        "chunk_id", "doc_id", "rank", "chunk_index", m["source"].alias("source"), m["type"].alias("type"), m["depth"].alias("depth"), "text"
    )


def _questions(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return emb.embed_text(asked, "query", loader=emb.gram_hashing(inputs.DIM))


def _chunk_hits(spark, sf):
    chunk_rows = cut_lineage(_store(spark, sf))
    return retrieve.topk_chunks(_questions(spark, sf), chunk_rows)


@register
def topk_chunks(spark, sf):
    return _chunk_hits(spark, sf).select("query_id", "rank", "chunk_id", _score())


@register
def topk_limits(spark, sf):
    """Each question asks for a number of hits of its own."""
    asked = _questions(spark, sf).withColumn("limit", (1 + F.col("query_id") % 5).cast("int"))
    rows = retrieve.topk_chunks(asked, cut_lineage(_store(spark, sf)))
    return rows.select("query_id", "rank", "chunk_id", _score())


@register
def topk_chunks_tiled(spark, sf):
    """The same search with both sides cut into tiles."""
    tiles = similarity.Limits(broadcast_rows=0, tile_rows=256, pivots=16)
    rows = retrieve.topk_chunks(_questions(spark, sf), cut_lineage(_store(spark, sf)), limits=tiles)
    return rows.select("query_id", "rank", "chunk_id", _score())


@register
def ordered_context(spark, sf):
    return _chunk_hits(spark, sf).orderBy("query_id", "rank").select("query_id", "rank", "text")


@register
def context_concat(spark, sf):
    return retrieve.context_text(_chunk_hits(spark, sf)).select("query_id", "context_text", "num_hits")


@register
def hit_payload(spark, sf):
    rows = retrieve.hit_payload(_chunk_hits(spark, sf))
    return rows.select(
        "query_id",
        "rank",
        "text",
        _score(),
        (F.col("metadata")["text"] == F.col("text")).alias("text_in_payload"),
        F.col("metadata")["source"].alias("source"),
    )


@register
def source_label(spark, sf):
    rows = _chunk_hits(spark, sf)
    return rows.select(
        "query_id",
        "rank",
        retrieve.source_label(F.col("metadata")).alias("label"),
        retrieve.score_label(F.col("score")).alias("score_label"),
    )


# ------------------------------------------------------------------ graph


def _mentions(spark, sf, parsed=None):
    """Mentions with given ids: the content id of the entity text."""
    rows = extraction.extracted_entities(parsed if parsed is not None else _parsed(spark, sf), BLOCK_KEYS)
    return rows.withColumn("entity_id", tx.content_id(emb.entity_text(F.col("name"), F.col("description"))))


def _by_id(spark, sf):
    parsed = _parsed(spark, sf)
    return graph.resolve_relations(extraction.extracted_relations(parsed, BLOCK_KEYS), _mentions(spark, sf, parsed), BLOCK_KEYS)


@register
def relation_resolution(spark, sf):
    return _by_id(spark, sf).select(*BLOCK_KEYS, "pos", "source_id", "target_id", "type")


@register
def unresolved_relations(spark, sf):
    parsed = _parsed(spark, sf)
    rows = graph.unresolved_relations(extraction.extracted_relations(parsed, BLOCK_KEYS), _mentions(spark, sf, parsed), BLOCK_KEYS)
    return rows.select(*BLOCK_KEYS, "pos", "source", "target", "type", "source_known", "target_known")


@register
def self_loops(spark, sf):
    return graph.without_self_loops(inputs.relations(spark, sf)).groupBy(*graph.EDGE).agg(F.count("*").alias("copies"))


@register
def missing_source(spark, sf):
    kept = graph.with_stored_source(inputs.relations(spark, sf), inputs.entities(spark, sf))
    return kept.groupBy("type").agg(F.count("*").alias("kept"), F.countDistinct("source_id").alias("sources"))


@register
def existing_semi_join(spark, sf):
    return graph.with_stored_source(
        graph.first_edges(inputs.relations(spark, sf)), inputs.entities(spark, sf)
    ).select(*graph.EDGE)


@register
def existing_anti_join(spark, sf):
    """Half of the edges, by a hash, are stored; all arrive."""
    edges = inputs.relations(spark, sf)
    stored = edges.where(F.md5(F.concat(*graph.EDGE).cast("binary")) < "8")
    return graph.new_edges(stored, graph.first_edges(edges)).select(*graph.EDGE)


@register
def edge_union_distinct(spark, sf):
    edges = inputs.relations(spark, sf)
    return graph.edge_union(edges.where("type <> 'borders'"), edges.where("type <> 'located_in'"))


@register
def adjacency(spark, sf):
    return graph.adjacency(graph.without_self_loops(inputs.relations(spark, sf)))


@register
def one_hop_neighbours(spark, sf):
    people = inputs.entities(spark, sf)
    entries = people.where("type in ('supplier', 'nation')").select(
        F.col("entity_id").alias("source_id"), F.col("name").alias("source_name")
    )
    edges = graph.first_edges(inputs.relations(spark, sf))
    return graph.one_hop(edges, entries, people).select("source_id", "source_name", "type", "target_id", "target_name")


@register
def graph_context_lines(spark, sf):
    """Context lines of every entity, each asked for on its own."""
    people = inputs.entities(spark, sf)
    entries = people.select(
        F.col("entity_id").alias("query_id"), F.lit(1).alias("rank"), "entity_id"
    )
    edges = graph.without_self_loops(inputs.relations(spark, sf))
    return graph.context_lines(entries, people, edges).select("query_id", "seq", "line")


@register
def resolve_entities(spark, sf):
    rows = resolution.resolve_entities(table(spark, sf, "embeddings"), RESOLVE_THRESHOLD, order="vec_id")
    return rows.select("vec_id", "leader_vec_id", _score())


@register
def resolve_entities_tiled(spark, sf):
    """The same resolution in several rounds over tiles."""
    tiles = similarity.Limits(broadcast_rows=0, tile_rows=128, pivots=8)
    rows = resolution.resolve_entities(
        table(spark, sf, "embeddings"), RESOLVE_THRESHOLD, order="vec_id", finish_rows=200, limits=tiles
    )
    return rows.select("vec_id", "leader_vec_id", _score())


def _graph(spark, sf):
    return ingest.build_graph(
        _parsed(spark, sf), loader=emb.gram_hashing(inputs.DIM), threshold=GRAPH_THRESHOLD, key=BLOCK_KEYS
    )


@register
def build_graph(spark, sf):
    people, edges = _graph(spark, sf)
    names = people.select("entity_id", "name")
    return edges.join(
        names.select(F.col("entity_id").alias("source_id"), F.col("name").alias("source_name")), "source_id"
    ).join(names.select(F.col("entity_id").alias("target_id"), F.col("name").alias("target_name")), "target_id").select(
        "source_id", "target_id", "type", "source_name", "target_name", "seq"
    )


@register
def graph_context(spark, sf):
    people, edges = _graph(spark, sf)
    people = cut_lineage(people)
    asked = _questions(spark, sf)
    entries = graph.entry_points(asked, people, threshold=ENTRY_THRESHOLD)
    return graph.graph_context(asked, entries, people, edges)


def _answers(spark, sf):
    people, edges = _graph(spark, sf)
    return retrieve.hybrid_query(
        _questions(spark, sf),
        cut_lineage(_store(spark, sf)),
        cut_lineage(people),
        edges,
        entry_threshold=ENTRY_THRESHOLD,
    )


@register
def answer_prompts(spark, sf):
    m = F.col("messages")
    return _answers(spark, sf).select(
        "query_id", m[0]["content"].alias("rules"), extraction.user_content(m).alias("content")
    )


@register
def hybrid_query(spark, sf):
    rows = _answers(spark, sf)
    return rows.select(
        "query_id",
        "query",
        "num_hits",
        F.round("best_score", 6).alias("best_score"),
        "context_text",
        F.array_join(
            F.transform("context", lambda c: F.concat(retrieve.source_label(c["metadata"]), F.lit(": "), c["text"])), "\n"
        ).alias("context"),
        "graph_summary",
        tx.approx_tokens(extraction.user_content(F.col("messages"))).alias("prompt_tokens"),
    )


# ------------------------------------------------------------- aggregates


@register
def doc_stats(spark, sf):
    rows = _documents(spark, sf).withColumn("filename", inputs.filename(F.col("doc_id"))).select(
        "doc_id",
        "text",
        "filename",
        files.suffix(F.col("filename")).alias("file_type"),
        F.lit(None).cast("int").alias("num_pages"),
    )
    return docs.doc_stats(rows).drop("num_pages")


@register
def ingest_summary(spark, sf):
    return docs.ingest_summary(docs.doc_stats(_documents(spark, sf).select("doc_id", "source", "text")), "source")


@register
def token_usage(spark, sf):
    """Tokens of each conversation's user turns, answered by the next turn."""
    rows = table(spark, sf, "conversations")
    replies = rows.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    calls = rows.where("role = 'user'").join(replies, ["conv_id", "turn"], "left")
    return extraction.token_usage(calls, ["conv_id"], "text", "reply")


@register
def duplicate_report(spark, sf):
    rows = ingest.identified(_chunks(spark, sf))
    return docs.duplicate_report(rows, ["doc_id", "chunk_index"])


@register
def latest_version(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return store.latest_version(rows, "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", F.round("value", 6).alias("value")
    )


@register
def chunk_offsets(spark, sf):
    return docs.chunk_offsets(_chunks(spark, sf))


# -------------------------------------------------------------------- web


@register
def extract_links(spark, sf):
    return web.extract_links(_pages(spark, sf))


@register
def internal_links(spark, sf):
    """Links of the linked sites, with those that stay on the site."""
    rows = inputs.site(spark, sf)
    hosts = rows.withColumn("host", urls.netloc(F.col("url")))
    return web.extract_links(hosts, ["page_id", "url", "host"], "host").select("page_id", "pos", "link")


@register
def invalid_start_url(spark, sf):
    """Page paths are no start urls: only whole urls are."""
    pages = table(spark, sf, "pages")
    whole = pages.select("page_id", "url")
    paths = pages.select("page_id", urls.path(F.col("url")).alias("url"))
    return web.invalid_starts(whole.unionByName(paths))


@register
def link_page_join(spark, sf):
    rows = inputs.site(spark, sf)
    return web.link_pages(web.extract_links(rows), rows).select("page_id", "pos", "link", "target_page_id")


@register
def visited_distinct(spark, sf):
    return web.extract_links(inputs.site(spark, sf)).select("link").dropDuplicates(["link"])


def _crawled(spark, sf, max_pages=CRAWL_PAGES, max_depth=CRAWL_DEPTH):
    return web.crawl(inputs.site_starts(spark, sf), inputs.site(spark, sf), max_pages, max_depth)


@register
def crawl_pages(spark, sf):
    return _crawled(spark, sf).select("crawl_id", "rank", "depth", "url", F.length("text").alias("chars"))


@register
def crawl_limit(spark, sf):
    return _crawled(spark, sf, CRAWL_LIMIT).select("crawl_id", "rank", "depth", "url")


@register
def combine_pages(spark, sf):
    return web.combine_pages(_crawled(spark, sf, WHOLE_PAGES, WHOLE_DEPTH))


@register
def union_page_chunks(spark, sf):
    rows = ingest.page_chunks(_crawled(spark, sf, WHOLE_PAGES, WHOLE_DEPTH))
    return rows.select("crawl_id", "rank", "url", "chunk_index", "start_char", "text")


# --------------------------------------------------- streaming, plug points


@register
def stream_ingest(spark, sf):
    """Documents arrive in three parts; the stream is stopped and started in between."""
    inbox, log, checkpoint = (scratch_path(spark, n) for n in ("inbox", "chunk-log", "ingest-state"))
    for part in inputs.arrivals(_documents(spark, sf), "doc_id"):
        part.write.mode("append").parquet(inbox)
        stream.start_ingest(stream.document_stream(spark, inbox), log, checkpoint, inputs.metadata()).awaitTermination()
    return stream.read_current(spark, log).select(
        "chunk_id", "doc_id", "chunk_index", "start_char", "end_char", "text", F.col("metadata")["filename"].alias("filename")
    )


def _event_stream(spark, sf, start):
    """Run a stream over the events, which arrive in three parts, stopping it in between."""
    state.use_state_store(spark)
    events = table(spark, sf, "events")
    inbox = scratch_path(spark, "events")
    for part in inputs.arrivals(events, "ts"):
        part.write.mode("append").parquet(inbox)
        start(spark.readStream.schema(events.schema).parquet(inbox)).awaitTermination()


@register
def stream_latest(spark, sf):
    log, checkpoint = scratch_path(spark, "latest-log"), scratch_path(spark, "latest-state")

    def start(events):
        rows = events.select("user_id", "event_id", "ts", "event_type", "value")
        return state.start_last_writes(rows, "user_id", ["ts", "event_id"], log, checkpoint)

    _event_stream(spark, sf, start)
    rows = store.latest_version(spark.read.parquet(log), "user_id", ["ts", "event_id"])
    return rows.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@register
def stream_quota(spark, sf):
    target, checkpoint = scratch_path(spark, "admitted"), scratch_path(spark, "quota-state")

    def start(events):
        rows = state.admitted(events, QUOTA)
        return (
            rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )

    _event_stream(spark, sf, start)
    rows = spark.read.parquet(target)
    return rows.select("event_id", "user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "over_limit")


@register
def quota_flags(spark, sf):
    return quota.quota_flags(table(spark, sf, "events"), QUOTA)


@register
def quota_counts(spark, sf):
    rows = quota.quota_counts(table(spark, sf, "events"), QUOTA)
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _echo_model():
    """A stand-in model: the size of the prompt; it refuses one prompt in seven, long or short."""

    def respond(prompts):
        sizes = [sum(len(m["content"]) for m in p if m["role"] == "user") for p in prompts]
        if any(n % 7 == 0 for n in sizes):
            raise ValueError("prompt refused")
        return [f"chars={n}" for n in sizes]

    return respond


@register
def apply_model(spark, sf):
    prompts = ingest.block_prompts(_documents(spark, sf))
    return extraction.apply_model(prompts, _echo_model).select("doc_id", "block_index", "response", "error")
