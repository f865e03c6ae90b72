import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

import reference_rules as rules
from corpusloom.functions import text as tx
from corpusloom.operators import documents as docs


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


EDGES = [
    "",
    "   \n\t ",
    "x" * 600 + ".",
    "Short. " + "y" * 700 + ". Tail.",
    ("a" * 255 + ". ") * 2 + "b" * 10 + ".",
    "a" * 511 + ". " + "b" * 512 + ".",
    "no sentence end " * 80,
    "One. Two! Three?　Vier. ​Fünf.\x1cSechs.\x85Sieben. ",
    "  lead. trail  ",
    "Ünïcode é. 😀 emoji! 日本語。 нет? да.",
    "A.. B?! C... D",
    "1.5 is no end. e.g.x",
    " ".join(f"S{i}." for i in range(400)),
]


def random_texts(n=300):
    rng = random.Random(7)
    alphabet = "abc é😀" + ".!?" + " \n  "
    return [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        + " ".join("w" * rng.randrange(1, 90) + rng.choice(". ! ? ,".split()) for _ in range(rng.randrange(0, 40)))
        for _ in range(n)
    ]


def test_sentences_equal_the_rule(spark):
    texts = EDGES + random_texts()
    got = {i: [] for i in range(len(texts))}
    for r in docs.sentences(frame(spark, texts)).orderBy("doc_id", "pos").collect():
        got[r.doc_id].append(r.sentence)
    assert [got[i] for i in range(len(texts))] == [rules.sentences(t) for t in texts]


@pytest.mark.parametrize("size,overlap", [(512, 50), (100, 20), (50, 10), (30, 30), (10, 0)])
def test_chunks_equal_the_rule(spark, size, overlap):
    texts = EDGES + random_texts()
    got = {i: [] for i in range(len(texts))}
    rows = docs.chunks(frame(spark, texts), size=size, overlap=overlap)
    for r in rows.orderBy("doc_id", "chunk_index").collect():
        got[r.doc_id].append((r.chunk_index, r.start_char, r.end_char, r.text))
    assert [got[i] for i in range(len(texts))] == [rules.chunks(t, size, overlap) for t in texts]


def test_offsets_are_running_sums(spark):
    rows = docs.chunks(frame(spark, random_texts(50)), size=60, overlap=25)
    given = rows.select("doc_id", "chunk_index", "start_char").collect()
    again = docs.chunk_offsets(rows).select("doc_id", "chunk_index", "start_char").collect()
    assert sorted(given) == sorted(again)


def test_four_sentences_make_several_chunks(spark):
    text = "The tide turned at noon. Boats lay on the mud. Gulls walked between them. Nobody was in a hurry."
    rows = docs.chunks(frame(spark, [text]), size=50, overlap=10).collect()
    assert len(rows) >= 2 and rows[0].chunk_index == 0


def test_metadata_is_copied_with_the_index(spark):
    df = spark.createDataFrame(
        [(1, "Rain fell on the pier.", {"source": "log", "leaf": "7", "chunk_index": "old"})],
        "doc_id long, text string, metadata map<string,string>",
    )
    row = docs.chunk_metadata(docs.chunks(df, size=200, overlap=20)).first()
    assert row.metadata == {"source": "log", "leaf": "7", "chunk_index": "0"}


def test_blocks(spark):
    texts = ["", "a", "abcde", "abcdef", "é😀" * 5]
    rows = docs.text_blocks(frame(spark, texts), size=5).orderBy("doc_id", "block_index").collect()
    want = [(d, n, t[i : i + 5]) for d, t in enumerate(texts) for n, i in enumerate(range(0, len(t), 5))]
    assert [tuple(r) for r in rows] == want


def test_both_ways_to_rejoin_agree(spark):
    df = frame(spark, EDGES + random_texts(40))
    one = docs.reassemble_text(docs.chunks(df, size=60, overlap=20)).collect()
    two = docs.rejoined_text(df, size=60, overlap=20).collect()
    assert sorted(one) == sorted(two)


def test_stats_count_chunks_within_the_row(spark):
    df = frame(spark, EDGES).withColumn("filename", F.lit("a.html"))
    got = {r.doc_id: (r.num_chunks, r.total_characters) for r in docs.doc_stats(df).collect()}
    assert got == {i: (len(rules.chunks(t)), len(t)) for i, t in enumerate(EDGES)}
    none = docs.doc_stats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert none.num_chunks == 0


def test_chunking_is_linear(spark):
    """Four times the sentences may take eight times as long, the best of three runs each; a quadratic fold takes sixteen times."""

    def best(n):
        df = frame(spark, [" ".join(f"Sentence {i} is here." for i in range(n))])
        took = []
        for _ in range(3):
            start = time.perf_counter()
            got = docs.chunks(df).agg(F.count("*").alias("n"), F.max("text").alias("last")).first()
            took.append(time.perf_counter() - start)
            assert n // 25 < got.n < n // 10 and got.last.startswith("Sentence")
        return min(took)

    best(10_000)
    assert best(160_000) < 8 * best(40_000)


def test_content_ids_are_uuid5(spark):
    texts = EDGES + random_texts(30)
    rows = frame(spark, texts).select("doc_id", tx.content_id(F.col("text")).alias("id")).collect()
    assert {r.doc_id: r.id for r in rows} == {i: str(uuid.uuid5(uuid.NAMESPACE_DNS, t)) for i, t in enumerate(texts)}


def test_tokens(spark):
    rows = frame(spark, ["", "abc", "abcd", "é" * 9]).select(tx.approx_tokens(F.col("text"))).collect()
    assert [r[0] for r in rows] == [0, 0, 1, 2]


def test_references_decode_once(spark):
    raw = "a &#38;lt; b &#x41;&#8364; &amp;amp; &#; &#12 &lt;x&gt; &copy;&nbsp;y &#55555; &#x1F600; &#000000000065; &#x0000000042; &#12345678901234567890123;"
    got = frame(spark, [raw]).select(tx.unescape(F.col("text"))).first()[0]
    assert got == "a &lt; b A€ &amp; &#; &#12 <x> © y &#55555; 😀 A B &#12345678901234567890123;"


def test_main_text(spark):
    html = """<html><head><title>T</title></head><body><nav><a href="/x">x</a></nav><!-- c -->
    <script>var a = "<p>no</p>";</script><h1>Head</h1><p>One <b>bold</b>&amp;
    more<br>line</p><table><tr><td>a</td><td>b</td></tr></table><footer>foot</footer></body></html>"""
    got = frame(spark, [html, ""]).select(tx.main_text(F.col("text"))).collect()
    assert [r[0] for r in got] == ["Head\nOne bold&\nmore\nline\na b", ""]
