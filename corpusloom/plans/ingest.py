"""Documents and pages to the chunk store, and model output to the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.once import compute_once
from corpusloom.operators import documents as docs
from corpusloom.operators import embedding as emb
from corpusloom.operators import extraction, graph
from corpusloom.operators.order import dense_order
from corpusloom.operators.resolution import RESOLVE_THRESHOLD, resolve_mentions
from corpusloom.operators.similarity import Limits
from corpusloom.operators.sizing import join_unique
from corpusloom.session import cut_lineage
from corpusloom.sources import files, store, web

# A chunk's place in the arrival order: batch, then document, then position.
ARRIVAL = ["batch_id", "doc_id", "chunk_index"]
ENTITY_COLUMNS = ["entity_id", "name", "type", "description", "embedding", "ord"]


def document_chunks(documents: DataFrame, metadata: Column | None = None, batch_id: int = 0, **sizes) -> DataFrame:
    """Chunk rows ready for the chunk log."""
    given = documents.select(
        "doc_id", "text", (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata")
    )
    rows = docs.chunk_metadata(docs.chunks(given, **sizes))
    return identified(rows, batch_id)


def identified(chunk_rows: DataFrame, batch_id: int = 0) -> DataFrame:
    """Add the content id and the batch."""
    return chunk_rows.withColumn("chunk_id", tx.content_id(F.col("text"))).withColumn(
        "batch_id", F.lit(batch_id).cast("long")
    )


def current_chunks(log: DataFrame) -> DataFrame:
    return store.latest_version(log, "chunk_id", ARRIVAL)


def chunk_store(documents: DataFrame, metadata: Column | None = None, **sizes) -> DataFrame:
    """The current chunks of a document table.

    Chunks are embedded after copies collapsed, each distinct text once.
    """
    return current_chunks(document_chunks(documents, metadata, **sizes))


def ingest_documents(documents: DataFrame, metadata: Column | None = None, loader=None, batch_id: int = 0, **sizes) -> DataFrame:
    """The current chunks of a document table with their vectors, ready to be stored and searched.

    Chunks are embedded after copies collapsed, each distinct text once.
    """
    return emb.embed_text(current_chunks(document_chunks(documents, metadata, batch_id, **sizes)), loader=loader)


def file_chunks(files_read: DataFrame, as_markdown: bool = False, **sizes) -> DataFrame:
    """Files ``filename, content`` to chunks, with what went wrong as rows of their own.

    ``filename, file_type, num_chunks, total_characters, error`` are those of the file. A file that
    is not accepted, has no parser here or holds no text is one row with an
    ``error`` and no chunk. Names are unique; content is read as UTF-8.
    """
    parsed = files.parse_markup(files_read, as_markdown)
    whole = compute_once(parsed, ["filename", "file_type", "error"], text=F.col("text"))
    chunked = compute_once(
        whole, ["filename", "file_type", "error"], found=tx.chunk_array(F.coalesce("text", F.lit("")), **sizes), size=F.length("text")
    )
    error = F.coalesce("error", F.when(F.size("found") == 0, F.lit("No text found")))
    rows = chunked.select(
        "filename", "file_type", F.size("found").alias("num_chunks"), F.col("size").alias("total_characters"), error.alias("error"),
        F.posexplode_outer("found").alias("chunk_index", "c"),
    )
    return rows.select(
        "filename", "file_type", "num_chunks", "total_characters", "error", "chunk_index", F.col("c.start").alias("start_char"),
        (F.col("c.start") + F.length("c.text")).alias("end_char"), F.col("c.text").alias("text"),
    )


def ingest_files(spark: SparkSession, path: str, loader=None, batch_id: int = 0, **sizes) -> tuple[DataFrame, DataFrame]:
    """A folder of files to stored chunks with vectors, and to the rows of files that gave none."""
    rows = file_chunks(files.read_files(spark, path), **sizes)
    about = docs.document_metadata(filename=F.col("filename"), file_type=F.col("file_type"))
    given = rows.where("error is null").select(F.col("filename").alias("doc_id"), "chunk_index", "start_char", "end_char", "text", about.alias("metadata"))
    current = store.latest_version(identified(docs.chunk_metadata(given), batch_id), "chunk_id", ARRIVAL)
    return emb.embed_text(current, loader=loader), rows.where("error is not null").select("filename", "file_type", "error")


def ingest_urls(
    starts: DataFrame, pages: DataFrame, max_pages: int, max_depth: int, loader=None, batch_id: int = 0, **sizes
) -> DataFrame:
    """Crawled pages as stored chunks with vectors.

    A chunk's ``doc_id`` is its crawl; its metadata name the page it is from
    (``source``), the kind of source (``type``) and how far from the start the
    page was (``depth``). The last arrival of a text is kept.
    """
    crawled = web.crawl(starts, pages, max_pages, max_depth)
    about = docs.document_metadata(source=F.col("url"), type=F.lit("web_page"), depth=F.col("depth"))
    given = crawled.select(F.col("crawl_id").alias("doc_id"), "rank", "text", about.alias("metadata"))
    rows = identified(docs.chunk_metadata(docs.chunks(given, **sizes)), batch_id)
    return emb.embed_text(store.latest_version(rows, "chunk_id", ["batch_id", "doc_id", "rank", "chunk_index"]), loader=loader)


def page_chunks(crawled: DataFrame, keys: list[str] = ["crawl_id", "rank", "url"], **sizes) -> DataFrame:
    """Chunks of crawled pages; ``chunk_index`` starts anew on every page."""
    return docs.chunks(crawled.select(*keys, "text"), **sizes)


def block_prompts(documents: DataFrame, key: str = "doc_id", size: int = tx.BLOCK_SIZE) -> DataFrame:
    """Extraction prompts per block of a document."""
    return extraction.extraction_prompts(docs.text_blocks(documents, key, size=size))


def entity_mentions(parsed: DataFrame, key: str | list[str] = "block_id", first: int = 0) -> DataFrame:
    """Extracted entities with ``ord``, their number in arrival order from ``first`` on.

    ``key`` names the column or columns that order the blocks.
    """
    keys = extraction.key_list(key)
    return dense_order(extraction.extracted_entities(parsed, keys), [*keys, "pos"], "ord", first)


def _after(stored: DataFrame | None, order: str) -> int:
    """The number that follows those of a stored table."""
    last = stored.agg(F.max(order)).first()[0] if stored is not None else None
    return 0 if last is None else last + 1


def build_graph(
    parsed: DataFrame,
    loader=None,
    threshold: float = RESOLVE_THRESHOLD,
    key: str | list[str] = "block_id",
    stored: tuple[DataFrame, DataFrame] | None = None,
    limits: Limits = Limits(),
    **resolution,
) -> tuple[DataFrame, DataFrame]:
    """Entity and relation tables from parsed extractions.

    Entities are resolved across all blocks in arrival order; the first writer
    keeps name, type and description. The id of an entity is the content id of
    its leader's text and place. Each distinct text is embedded and compared once.

    ``key`` names the column or columns that order the blocks. ``stored`` is what
    an earlier call returned, of earlier blocks: the new blocks then extend that
    graph, and the result is the whole of it.
    """
    keys = extraction.key_list(key)
    old_people, old_edges = stored or (None, None)
    parsed = cut_lineage(parsed.select(*keys, "entities", "relations"))
    mentions = entity_mentions(parsed, keys, _after(old_people, "ord"))
    texts = mentions.withColumn("entity_text", emb.entity_text(F.col("name"), F.col("description")))
    once = texts.groupBy("entity_text").agg(F.min("ord").alias("text_ord"))
    vectors = cut_lineage(emb.embed_text(once, "entity_text", loader=loader))
    marked = join_unique(texts, cut_lineage(once), "entity_text", ["ord"], ["entity_text"])
    marked = cut_lineage(marked.select(*keys, "pos", "name", "type", "description", "entity_text", "ord", "text_ord"))
    known = old_people.select("ord", "embedding") if stored else None
    links = cut_lineage(resolve_mentions(marked.select("ord", "text_ord"), vectors, threshold, stored=known, limits=limits, **resolution))
    place = F.concat_ws("/", *[F.col(k).cast("string") for k in [*keys, "pos"]])
    led = marked.join(links.where("ord = leader_ord").select("ord"), "ord").withColumn(
        "entity_id", tx.content_id(F.concat_ws("#", "entity_text", place))
    )
    led = join_unique(led, vectors.select("text_ord", "embedding"), "text_ord", ["ord"], limit=0)
    entities = led.select(*ENTITY_COLUMNS)
    if stored:
        entities = old_people.select(*ENTITY_COLUMNS).unionByName(entities)
    entities = cut_lineage(entities)
    ids = entities.select(F.col("ord").alias("leader_ord"), "entity_id")
    led_by = marked.select(*keys, "pos", "name", "ord").join(links.select("ord", "leader_ord"), "ord")
    named = join_unique(led_by, ids, "leader_ord", ["ord"], ["entity_id"])
    by_id = graph.resolve_relations(extraction.extracted_relations(parsed, keys), named, keys)
    rows = graph.without_self_loops(by_id).select(*keys, "pos", *graph.EDGE)
    found = dense_order(rows, [*keys, "pos"], "seq", _after(old_edges, "seq")).select(*graph.EDGE, "seq")
    edges = old_edges.select(*graph.EDGE, "seq").unionByName(found) if stored else found
    return entities, graph.first_edges(edges)


def ingest_crawl(starts: DataFrame, pages: DataFrame, max_pages: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Chunks and the combined text of each crawl."""
    crawled = web.crawl(starts, pages, max_pages, max_depth)
    return page_chunks(crawled), web.combine_pages(crawled)
