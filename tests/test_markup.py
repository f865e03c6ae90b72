"""Blocks, main content and Markdown against a reading tag by tag; files as one job."""

import pyarrow.parquet as pq
import pytest
import reference_rules as rules
from pyspark.sql import functions as F

from corpusloom.checks.queries import REGISTRY
from corpusloom.functions import markup
from corpusloom.functions.once import compute_once
from corpusloom.plans import ingest
from corpusloom.sources import files, web

LONG = "This is running text of the page, long enough to be taken for content"
PAGES = [
    None, "", "plain only", "<p", "a < b <3 c", "<!-- only -->", "<html><body></body></html>",
    f"<h1>Head <b>line</b></h1><p>{LONG}<br>two.<div class='ad'><div>Buy this now, it is the best of all.</div>more</div><p>{LONG}</p>",
    "<ul><li>a<ul><li>b &lt; c</li></ul></li><li>c</ul><ol><li>x<p>y</ol>z",
    "<table><tr><th>a|x</th><th>b</th></tr><tr><td><p>1</p><ul><li>l</ul></td><td><a href='q'>2</a></td></tr></table><table><tr><td>only</table>",
    "<pre>\n code\n   x\n</pre><blockquote>quoted <i>text</i></blockquote>",
    f"<nav><a href=x>x</a></nav><header>Top</header><ul class='Main Menu'><li>{LONG}</ul><ul><li>after</ul><main>{LONG}</main><footer id=f>foot</footer>",
    f"<div id='side-bar share'>{LONG}</div><span class=ad>{LONG}<span>x</span></span><p class='a shared'>{LONG}</p>",
    f"<h2>Lost</h2><p><a href=1>one link</a> <a href=2>and one more, both of some length</a></p><h3>Kept</h3><p>short</p><p>{LONG}</p><p>tiny</p><p>Ends.</p>",
    "<p>x</p><script>var a = '<p>no</p>';</script><svg><svg/><path/></svg><select><option>o</select><BR/>y<a title='>'>z</a>",
    "".join(f"<p>Sentence {i} of many.</p><a href={i}>l</a>" for i in range(700)),
]


@pytest.fixture(scope="module")
def pages(spark, folder):
    given = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()]
    given += [(1000 + i, f"u{i}", h) for i, h in enumerate(PAGES)]
    return spark.createDataFrame(given, "page_id long, url string, html string"), given


def test_blocks(spark, pages):
    df, given = pages
    for main_only in (False, True):
        rows = compute_once(df, ["page_id"], b=markup.blocks(F.col("html"), main_only)).collect()
        got = {r.page_id: [tuple(b) for b in r.b] for r in rows}
        assert got == {k: rules.page_blocks(h, main_only) for k, _, h in given}


def test_main_content(pages):
    df, given = pages
    got = {r.page_id: (r.text, r.n_blocks, r.n_kept) for r in web.main_content(df).collect()}
    assert got == {k: rules.main_text(h) for k, _, h in given}
    assert got[1007][0] == f"Head line\n{LONG}\ntwo.\n{LONG}"
    assert got[1013][0] == f"Kept\n{LONG}\ntiny\nEnds." and got[1011][0] == LONG
    ad = lambda h: h.split('<div class="ad">')[1].split("</div>")[0]
    foot = lambda h: h.split("<footer>")[1].split("</footer>")[0].split(";")[-1].strip()
    for k, _, h in given[:40]:
        text = got[k][0]
        article = h.split("<article>")[1]
        assert text and (ad(h) in article or ad(h) not in text) and (foot(h) in article or foot(h) not in text)


def test_markdown(pages):
    df, given = pages
    got = {r.page_id: r.markdown for r in web.page_markdown(df).collect()}
    assert got == {k: rules.as_markdown(h) for k, _, h in given}
    assert got[1008] == "- a\n  - b < c\n- c\n1. x\n1. y\n\nz"
    assert got[1009].startswith("| a\\|x | b |\n| --- | --- |\n| 1 l | 2 |")
    assert got[1010] == "```\n code\n   x\n```\n\n> quoted text"


@pytest.mark.parametrize("name", ["page_main_text", "page_markdown"])
def test_registered_queries_read_every_page(spark, folder, name):
    given = pq.read_table(f"{folder}/pages.parquet").to_pylist()
    rule = {"page_main_text": rules.main_text, "page_markdown": lambda h: (rules.as_markdown(h),)}[name]
    got = {r[0]: tuple(r)[2:] for r in REGISTRY[name](spark, folder).collect()}
    assert got == {r["page_id"]: rule(r["html"]) for r in given}


def test_files_as_one_job(spark, tmp_path):
    path = str(tmp_path / "drop")
    rows = [("a b+c%20.html", "<h1>T</h1><p>One. Two.</p>"), ("e.htm", "<p></p>"), ("n.txt", "text"), ("p.PDF", "%PDF"), (None, "x"), ("z.html", None), ("none", "x")]
    files.write_files(spark.createDataFrame(rows, "filename string, content string"), path)
    (tmp_path / "drop" / "plain.html").write_text("<ul><li>Caf\u00e9.</ul>")
    got = {r.filename: (r.file_type, r.num_chunks, r.error, r.chunk_index, r.text) for r in ingest.file_chunks(files.read_files(spark, path)).collect()}
    assert got == {
        "a b+c%20.html": (".html", 1, None, 0, "T\nOne. Two."),
        "plain.html": (".html", 1, None, 0, "Caf\u00e9."),
        "e.htm": (".htm", 0, "No text found", None, None),
        "n.txt": (".txt", 0, "Unsupported file type: .txt", None, None),
        "p.PDF": (".pdf", 0, "No parser for .pdf", None, None),
        "none": ("", 0, "Unsupported file type: ", None, None),
    }
    stored, failed = ingest.ingest_files(spark, path)
    assert sorted(r.doc_id for r in stored.collect()) == ["a b+c%20.html", "plain.html"] and failed.count() == 4
    marked = ingest.file_chunks(files.read_files(spark, path), as_markdown=True).where("chunk_index = 0")
    assert sorted(r.text for r in marked.collect()) == ["# T\n\nOne. Two.", "- Caf\u00e9."]


def test_files_are_written_without_companions(spark, tmp_path, monkeypatch):
    names = ["".join(map(chr, range(1, 64))), "".join(map(chr, range(64, 160))), "\u00e9 \u6f22 +%2B.html", "", "a/b.html", "..", " x."]
    rows = [(n, f"text {i}") for i, n in enumerate(names)] + [("a/b.html", "once more"), (None, "x"), ("n", None)]
    df = spark.createDataFrame(rows, "filename string, content string").repartition(3)
    files.write_files(df, str(tmp_path / "plain"))
    assert sorted(p.name for p in (tmp_path / "plain").rglob("*") if p.is_file()) == ["part-00000.txt"] * len(names)
    monkeypatch.setattr(files, "mounted_path", lambda spark, path: None)
    files.write_files(df, str(tmp_path / "spark"))
    got = [{r.filename: sorted(bytes(r.content).split(b"\n")) for r in files.read_files(spark, str(tmp_path / k)).collect()} for k in ("plain", "spark")]
    assert got[0] == got[1] and len(got[0]) == len(names) and got[0]["a/b.html"] == [b"", b"once more", b"text 4"]
    with pytest.raises(Exception):
        files.write_files(df, str(tmp_path / "plain"))
    monkeypatch.undo()
    with pytest.raises(FileExistsError):
        files.write_files(df, str(tmp_path / "plain"))
    files.write_files(df.limit(0), str(tmp_path / "none"))
    assert files.read_files(spark, str(tmp_path / "none")).count() == 0
