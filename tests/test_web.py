import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

import reference_rules as rules
from corpusloom.plans import ingest
from corpusloom.sources import web

BASE = "http://example.com"


def page(*links, text="Body text."):
    anchors = "".join(f'<a href="{u}">x</a>' for u in links)
    return f"<html><body><!-- <a href='/hidden'>h</a> --><p>{text}</p>{anchors}</body></html>"


SITE = {
    BASE: page("/a", "b/c", "/a", "/gone", "#top", "http://other.com/x", "/file.PDF", "//example.com/d?q=1"),
    f"{BASE}/a": page("/", "/deep", BASE, "?p=2"),
    f"{BASE}/b/c": page("d", "../a", text=""),
    f"{BASE}/b/d": page("/never"),
    f"{BASE}/": page("/a"),
    f"{BASE}/deep": page("/deeper"),
    f"{BASE}/deeper": page("/deepest"),
    f"{BASE}/deepest": page(BASE),
    f"{BASE}/d?q=1": page("/deep"),
    f"{BASE}/a?p=2": page("/b/d"),
    "http://other.com/x": page("/y"),
    "http://other.com/y": page("/x"),
}
# A page with no text of its own still has link texts; empty it for real.
SITE[f"{BASE}/b/c"] = "<html><body></body></html>"


def links_of(url):
    out = []
    html = re.sub(r"<!--.*?-->", "", SITE[url.split("#")[0]])
    for href in re.findall(r'href="([^"]*)"', html):
        full = urljoin(url, href)
        parsed = urlparse(full)
        if parsed.netloc == urlparse(url).netloc and not parsed.path.lower().endswith((".pdf", ".jpg")):
            out.append(full)
    return out


def frames(spark):
    pages = spark.createDataFrame([(u, h) for u, h in SITE.items()], "url string, html string").repartition(3)
    starts = spark.createDataFrame(
        [(1, BASE), (2, "http://other.com/x"), (3, f"{BASE}/deep"), (4, "/no-host"), (5, f"{BASE}/unknown")],
        "crawl_id long, url string",
    )
    return starts, pages


@pytest.mark.parametrize("max_pages,max_depth", [(10, 2), (3, 2), (1, 2), (50, 5), (5, 0)])
def test_crawl_equals_a_queue(spark, max_pages, max_depth):
    starts, pages = frames(spark)
    texts = {u: "" if "<p>" not in h else "x" for u, h in SITE.items()}
    got = {}
    for r in web.crawl(starts, pages, max_pages, max_depth).orderBy("crawl_id", "rank").collect():
        got.setdefault(r.crawl_id, []).append((r.rank, r.url, r.depth))
    for crawl_id, start in [(1, BASE), (2, "http://other.com/x"), (3, f"{BASE}/deep")]:
        want = rules.crawl(start, texts, links_of, max_pages, max_depth)
        assert got[crawl_id] == [(n + 1, u, d) for n, (u, d) in enumerate(want)]
    assert set(got) == {1, 2, 3}


LINKS = {
    "tide/table": f"{BASE}/harbour/tide/table",
    "//example.com/pier?boat=2&amp;berth=3": f"{BASE}/pier?boat=2&berth=3",
    "../lamp#light": f"{BASE}/lamp#light",
    "https://example.com/": "https://example.com/",
    "https://elsewhere.net/pier": None,
    "chart.PNG": None,
    "mailto:keeper@example.com": None,
}


class Anchors(HTMLParser):
    """The hrefs of a page by the standard library."""

    def __init__(self, html):
        super().__init__()
        self.found = []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.found += [v for k, v in attrs if tag == "a" and k == "href" and v is not None]


def test_links_that_stay_on_the_host(spark):
    anchors = [f"<li><a class='k' href='{u}'>{i}</a>" for i, u in enumerate(LINKS)]
    html = "<ul>" + "".join(anchors) + "</ul><area href='/no'><A\n HREF=\"/last\" >z</A><a id=none>n</a><!-- <a href='/gone'> -->"
    df = spark.createDataFrame([(1, f"{BASE}/harbour/log", html)], "page_id long, url string, html string")
    got = [r.link for r in web.extract_links(df).orderBy("pos").collect()]
    assert got == [u for u in LINKS.values() if u] + [f"{BASE}/last"]
    assert len(Anchors(html).found) == len(LINKS) + 1


def test_links_and_text_equal_the_standard_parser(spark, folder):
    """Real pages: the hrefs of a second parser, made whole by the standard library."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = []
    for r in pages.collect():
        host = urlparse(r.url).netloc
        for href in Anchors(r.html).found:
            full = urljoin(r.url, href)
            if urlparse(full).netloc == host and host:
                want.append((r.page_id, full))
    got = [(r.page_id, r.link) for r in web.extract_links(pages).collect()]
    assert set(got) <= set(want)


def test_one_row_per_url_of_a_crawl(spark):
    """Copies of a page, with and without text, take one place of the limit."""
    rows = [(BASE, page("/b", "/c", text="home")), (f"{BASE}/b", page(text="second")), (f"{BASE}/b", page(text="first"))]
    rows += [(f"{BASE}/b#x", "<html></html>"), (f"{BASE}/c", page(text="third")), (BASE, page("/b", "/c", text="home"))]
    pages = spark.createDataFrame(rows, "url string, html string")
    starts = spark.createDataFrame([(1, BASE)], "crawl_id long, url string")
    got = [(r.rank, r.url, r.text.split("\n")[0]) for r in web.crawl(starts, pages, 3, 2).orderBy("rank").collect()]
    assert got == [(1, BASE, "home"), (2, f"{BASE}/b", "first"), (3, f"{BASE}/c", "third")]
    links = web.extract_links(pages.withColumn("page_id", F.monotonically_increasing_id()))
    joined = web.link_pages(links, pages.withColumn("page_id", F.monotonically_increasing_id()))
    assert joined.count() == links.count()


def test_records_and_rejects(spark):
    df = spark.createDataFrame(
        [(1, BASE, page(text="Some content")), (2, f"{BASE}/e", "<html><body></body></html>"), (3, f"{BASE}/n", None)],
        "page_id long, url string, html string",
    )
    row = web.page_records(df).collect()
    assert [(r.url, r.text.split("\n")[0], r.source, r.type) for r in row] == [(BASE, "Some content", BASE, "web_page")]
    assert sorted((r.page_id, r.error) for r in web.rejected_pages(df).collect()) == [(2, "no text"), (3, "nothing fetched")]


def test_starts_without_host_are_errors(spark):
    starts, _ = frames(spark)
    assert [(r.crawl_id, r.error) for r in web.invalid_starts(starts).collect()] == [(4, "Invalid start URL: /no-host")]


def test_crawl_to_chunks_and_text(spark):
    starts, pages = frames(spark)
    chunks, texts = ingest.ingest_crawl(starts, pages, 5, 2)
    first = {(r.crawl_id, r.rank): r.chunk_index for r in chunks.collect()}
    assert set(first.values()) == {0}
    joined = {r.crawl_id: r.full_text for r in texts.collect()}
    assert joined[2].count("\n\n---PAGE BREAK---\n\n") == 1


def test_a_level_reads_the_buckets_of_its_frontier(spark):
    rows = [(f"http://a.org/{i}#x" if i % 7 else f"http://a.org/{i}", f"<p>Page {i}.</p><a href='/{i + 1}'>n</a>") for i in range(300)]
    pages = spark.createDataFrame(rows, "url string, html string")
    stored = web.store_pages(pages, buckets=64)
    assert stored.rows.count() == 300
    folders = lambda df: {r[0].split("bucket=")[1].split("/")[0] for r in df.select(F.input_file_name()).distinct().collect()}
    frontier = spark.createDataFrame([("http://a.org/5",), ("http://a.org/77",), ("http://a.org/none",)], "_key string")
    asked = stored.asked(frontier)
    assert 1 <= len(folders(asked)) <= 3 < len(folders(stored.rows)) <= 64
    scan = asked._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert {"http://a.org/5", "http://a.org/77"} <= {r._key for r in asked.collect()}
    assert stored.asked(frontier.limit(0)).count() == 0
    starts = spark.createDataFrame([(1, "http://a.org/0"), (2, "http://a.org/9")], "crawl_id long, url string")
    one, two = (sorted(map(tuple, web.crawl(starts, p, 3, 3).collect())) for p in (pages, stored))
    assert one == two and len(one) == 6
