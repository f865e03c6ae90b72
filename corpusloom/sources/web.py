"""Fetched web pages: text, links and breadth-first crawls over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import markup
from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.functions.once import compute_once
from corpusloom.operators.documents import PAGE_BREAK, join_ordered
from corpusloom.operators.sizing import broadcast_if_small, join_unique
from corpusloom.session import cut_lineage, scratch_path

# Buckets of a stored page table, the pages that one is meant for, and the tasks that write it.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_PAGES, BUCKET_TASKS = 16, 4096, 4096, 4

MAX_PAGES = 10
MAX_DEPTH = 2

HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def page_text(pages: DataFrame, keep: list[str] = []) -> DataFrame:
    """Pages with their readable text; empty where there is none."""
    return compute_once(pages, ["page_id", "url", *keep], text=tx.main_text(F.coalesce("html", F.lit(""))))


def main_content(pages: DataFrame, keep: list[str] = []) -> DataFrame:
    """Pages with the text of their main content: ``text``, one line per block, and ``n_blocks, n_kept``.

    Navigation, headers, footers, forms and what a class or id marks as an
    advertisement, a comment or the like are left out, and of the other blocks
    those that are short or mostly links (:func:`corpusloom.functions.markup.main_blocks`).
    Rows of tables are kept. Null and empty pages have an empty text.
    """
    found = compute_once(pages, ["page_id", "url", *keep], _all=markup.blocks(F.col("html"), main_only=True))
    main = compute_once(found, ["page_id", "url", *keep, "_all"], _main=markup.main_blocks(F.col("_all")))
    return main.select(
        "page_id", "url", *keep, markup.blocks_text(F.col("_main")).alias("text"), F.size("_all").alias("n_blocks"), F.size("_main").alias("n_kept")
    )


def page_markdown(pages: DataFrame, keep: list[str] = []) -> DataFrame:
    """Whole pages as Markdown: headings, lists, tables, code, quotes and paragraphs."""
    found = compute_once(pages, ["page_id", "url", *keep], _all=markup.blocks(F.col("html")))
    return found.select("page_id", "url", *keep, markup.markdown(F.col("_all")).alias("markdown"))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages with text as records ``url, text, source, type``."""
    return (
        page_text(pages)
        .where(F.col("text") != "")
        .select("page_id", "url", "text", F.col("url").alias("source"), F.lit("web_page").alias("type"))
    )


def rejected_pages(pages: DataFrame) -> DataFrame:
    """Pages that give no record, with the reason."""
    missing = F.coalesce(F.col("html"), F.lit("")) == ""
    reason = F.when(missing, F.lit("nothing fetched")).otherwise(F.lit("no text"))
    return page_text(pages.withColumn("error", reason), ["error"]).where(F.col("text") == "").drop("text")


def extract_links(pages: DataFrame, keys: list[str] = ["page_id", "url"], domain: str | None = None) -> DataFrame:
    """Internal links in document order, resolved; repeats are kept.

    ``domain`` names a column with the host to stay on (default: the host of
    the page itself).
    """
    shown = tx.drop_hidden(F.coalesce("html", F.lit("")))
    found = pages.select(
        *keys,
        (F.col(domain) if domain else urls.netloc(F.col("url"))).alias("_domain"),
        F.posexplode(F.regexp_extract_all(shown, F.lit(HREF), 1)).alias("pos", "_raw"),
    )
    href = F.trim(tx.unescape(F.regexp_replace("_raw", r"""^["']|["']$""", "")))
    refs = compute_once(found, href=href)
    links = compute_once(refs, link=urls.join(F.col("url"), F.col("href")))
    return links.where(urls.is_internal(F.col("link"), F.col("_domain"))).select(*keys, "pos", "href", "link")


def valid_starts(starts: DataFrame) -> DataFrame:
    return starts.where(urls.netloc(F.col("url")) != "")


def invalid_starts(starts: DataFrame) -> DataFrame:
    """Start urls without a host, with the error they cause."""
    return starts.where(F.coalesce(urls.netloc(F.col("url")), F.lit("")) == "").withColumn(
        "error", F.concat(F.lit("Invalid start URL: "), F.col("url"))
    )


def fetch_key(url: Column) -> Column:
    """What a fetch of the url asks for: the url without its fragment."""
    return F.regexp_replace(url, r"#.*$", "")


def _one_page(pages: DataFrame, value: str) -> DataFrame:
    """One row per fetch key: the smallest ``value`` of the pages with that key."""
    return pages.groupBy(fetch_key(F.col("url")).alias("_key")).agg(F.min(value).alias(value))


def link_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links joined to the fetched page they lead to.

    Of several pages with one url the one with the smallest id is meant; a url
    that very many links share is dealt out to several tasks.
    """
    target = _one_page(pages, "page_id").withColumnRenamed("page_id", "target_page_id")
    keyed = links.withColumn("_key", fetch_key(F.col("link")))
    return join_unique(keyed, target, "_key", ["page_id", "pos"], ["_key"]).drop("_key")


@dataclass(frozen=True)
class StoredPages:
    """Pages ``_key, html, bucket`` in folders by the hash of what a fetch asks for."""

    rows: DataFrame
    buckets: int

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def asked(self, frontier: DataFrame) -> DataFrame:
        """The pages in the buckets that the ``_key`` of the frontier's rows fall into; no other folder is read."""
        # At most as many numbers as there are buckets.
        wanted = [r.bucket for r in frontier.select(self.bucket("_key").alias("bucket")).distinct().collect()]
        return self.rows.where(F.col("bucket").isin(wanted)).drop("bucket")


def store_pages(pages: DataFrame, buckets: int | None = None) -> StoredPages:
    """Write pages ``url, html`` once, so that a level of a crawl reads those it may ask for only.

    There is a bucket for some thousand pages, up to a fixed number, unless ``buckets`` says
    how many. A bucket is written by several tasks, as one url may have very many pages.
    """
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, pages.count() // BUCKET_PAGES))
    keyed = pages.select(fetch_key(F.col("url")).alias("_key"), "html")
    bucket = F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")
    dealt = keyed.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("html"), F.lit(BUCKET_TASKS)))
    path = scratch_path(pages.sparkSession, "pages")
    dealt.write.partitionBy("bucket").parquet(path)
    schema = T.StructType([*keyed.schema.fields, T.StructField("bucket", T.IntegerType())])
    return StoredPages(pages.sparkSession.read.schema(schema).parquet(path), buckets)


def crawl(
    starts: DataFrame,
    pages: DataFrame | StoredPages,
    max_pages: int = MAX_PAGES,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Breadth-first crawls over a table of fetched pages, many at once.

    ``starts(crawl_id, url)``, one row per crawl, and ``pages(url, html)``. Of
    several pages with one url (its fragment aside) the one whose text is the
    smallest, among those with any, is the page.
    Result: ``crawl_id, url, depth, rank, text``; ``rank`` is the order of the
    queue. A url is visited once per crawl, a page without text or not in the
    table does not count, and a crawl ends with ``max_pages`` pages.

    Pages are stored by the hash of their url first, or were by :func:`store_pages`;
    a level reads the buckets that its frontier falls into.

    Levels are joined one after the other. Per crawl no more than
    ``max_pages`` pages of a level go on, and the rank limit already trims
    every task's rows before the shuffle, so one huge site is no hot spot.
    """
    start_rows = valid_starts(starts).select(
        "crawl_id",
        "url",
        urls.netloc(F.col("url")).alias("domain"),
        F.lit(0).cast("long").alias("parent"),
        F.lit(0).alias("pos"),
    )
    frontier = cut_lineage(start_rows)
    seen = frontier.select("crawl_id", "url")
    stored = pages if isinstance(pages, StoredPages) else store_pages(pages)
    results = None
    for depth in range(max_depth + 1):
        wanted = frontier.withColumn("_key", fetch_key(F.col("url")))
        asked = broadcast_if_small(wanted, ["url", "_key"])
        found = compute_once(stored.asked(wanted).join(asked, "_key"), text=tx.main_text(F.coalesce("html", F.lit(""))))
        texts = found.where(F.col("text") != "")
        order = Window.partitionBy("crawl_id").orderBy("parent", "pos")
        # Pages with one url share a place in the queue, and so a rank.
        level = texts.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= max_pages)
        same = Window.partitionBy("crawl_id", "_n").orderBy("text", "html")
        level = level.withColumn("_copy", F.row_number().over(same)).where("_copy = 1")
        if results is not None:
            done = results.groupBy("crawl_id").agg(F.count("*").alias("_done"))
            level = level.join(done, "crawl_id", "left")
            rank = F.col("_n") + F.coalesce("_done", F.lit(0))
        else:
            rank = F.col("_n").cast("long")
        level = cut_lineage(
            level.withColumn("rank", rank.cast("long"))
            .where(F.col("rank") <= max_pages)
            .select("crawl_id", "url", "domain", F.lit(depth).alias("depth"), "rank", "html", "text")
        )
        kept = level.select("crawl_id", "url", "depth", "rank", "text")
        results = kept if results is None else results.unionByName(kept)
        if depth == max_depth:
            break
        links = extract_links(level, ["crawl_id", "url", "rank", "domain"], "domain")
        first = F.min(F.struct(F.col("rank").alias("parent"), "pos")).alias("_first")
        # A crawl that is full has nothing left to visit.
        full = results.groupBy("crawl_id").agg(F.count("*").alias("_have")).where(F.col("_have") >= max_pages)
        frontier = cut_lineage(
            links.groupBy("crawl_id", F.col("link").alias("url"), "domain")
            .agg(first)
            .join(seen, ["crawl_id", "url"], "left_anti")
            .join(full, "crawl_id", "left_anti")
            .select("crawl_id", "url", "domain", "_first.parent", "_first.pos")
        )
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("crawl_id", "url"))
    return results


def combine_pages(crawled: DataFrame) -> DataFrame:
    """One text per crawl, pages in crawl order; at most ``max_pages`` each."""
    return join_ordered(crawled, ["crawl_id"], ["rank"], PAGE_BREAK, "full_text")
