from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.sources import files

BASES = ["http://example.com", "http://example.com/a/b.html", "https://h.org:8080/d/e/?q=1#f", "http://example.com/a/b/c"]
REFS = [
    "/page1", "http://example.com/page2", "http://google.com", "/image.jpg", "x.html", "../up", "../../far/../up2",
    "./here", "?q=2", "#top", "", "//cdn.example.com/z", "mailto:me@x.org", "/a/./b/../c", "sub/", "..", "/ä/für", "x?y#z", "/p#",
]


def test_join_equals_urljoin(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(pairs, "base string, ref string")
    got = df.select("base", "ref", urls.join(F.col("base"), F.col("ref")).alias("u")).collect()
    wrong = [(r.base, r.ref, r.u, urljoin(r.base, r.ref)) for r in got if r.u != urljoin(r.base, r.ref)]
    assert not wrong


def test_parts_equal_urlparse(spark):
    all_urls = [urljoin(b, r) for b in BASES for r in REFS] + ["no-host", "/path/only", "HTTP://Up.Case/x"]
    df = spark.createDataFrame([(u,) for u in all_urls], "u string")
    u = F.col("u")
    for r in df.select("u", urls.scheme(u).alias("s"), urls.netloc(u).alias("n"), urls.path(u).alias("p")).collect():
        want = urlparse(r.u)
        assert (r.s, r.n, r.p.split(";")[0]) == (want.scheme, want.netloc, want.path), r.u


def test_internal(spark):
    rows = [
        ("http://example.com/page1", True),
        ("https://example.com/x", True),
        ("http://google.com", False),
        ("http://example.com/image.JPG", False),
        ("http://example.com/a.pdf?x=1", False),
        ("ftp://example.com/a", False),
        ("http://example.com:81/a", False),
    ]
    df = spark.createDataFrame(rows, "u string, want boolean")
    got = df.select(urls.is_internal(F.col("u"), F.lit("example.com")).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_uploads(spark):
    names = [("A.PDF",), ("b.txt",), ("c",), ("d.tar.html",), (None,), ("",), (".html",), ("x/.jpg",), ("dir.d/e.Jpeg",)]
    got = files.admit(spark.createDataFrame(names, "filename string")).collect()
    assert [(r.filename, r.file_type, r.accepted) for r in got] == [
        ("A.PDF", ".pdf", True),
        ("b.txt", ".txt", False),
        ("c", "", False),
        ("d.tar.html", ".html", True),
        ("unknown", "", False),
        ("unknown", "", False),
        (".html", "", False),
        ("x/.jpg", "", False),
        ("dir.d/e.Jpeg", ".jpeg", True),
    ]
    assert got[1].error == "Unsupported file type: .txt" and got[0].error is None


def test_files_are_read_and_parsed(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><body><p>Grüße &amp; more</p></body></html>", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.txt").write_text("plain")
    rows = {r.filename: r for r in files.parse_markup(files.read_files(spark, str(tmp_path))).collect()}
    assert rows["a.html"].text == "Grüße & more" and rows["a.html"].error is None
    assert rows["b.pdf"].text is None and rows["b.pdf"].error == "No parser for .pdf"
    assert rows["c.txt"].error == "Unsupported file type: .txt"
