"""The index against plain search, and removed words against a plain search for every window."""

import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import queries, substring_dedup
from corpusloom.llm.fm_index import FmIndex
from corpusloom.llm.word_hashes import hashed_words

W = substring_dedup.WIDTH


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_every_window(seed):
    rng = random.Random(seed)
    size, width = rng.choice([2, 4, 30]), rng.choice([1, 2, 5, 13])
    made = lambda least, longest: [rng.randrange(least, size + 1) for _ in range(rng.randrange(1, longest))]
    held = [made(1, 22) for _ in range(rng.randrange(1, 60))]
    held += [held[0]] * 3
    index = FmIndex(np.array([x for s in held for x in [*s, 0]]), size + 1, max(map(len, held)), width)
    read = [made(0, 40) for _ in range(40)] + held[:5] + [held[0] + held[-1] + held[0]]
    sizes = np.array([len(q) for q in read])
    at, low, high = index.windows(np.array([x for q in read for x in q]), np.cumsum(sizes), sizes)
    got = {int(a): sorted(index.rows[lo:hi].tolist()) for a, lo, hi in zip(at, low, high)}
    want, base = {}, 0
    for q in read:
        for i in range(len(q) - width + 1):
            hits = [k for k, s in enumerate(held) for j in range(len(s) - width + 1) if s[j : j + width] == q[i : i + width]]
            if hits:
                want[base + i] = hits
        base += len(q)
    assert got == want


def test_words_across_parts(monkeypatch):
    from corpusloom.llm import word_hashes

    texts = [b"", b" \t", b"one two  one", b"x" * 50 + b" one", b"\x0bone\x0c\xc3\xa9\xc2\xa0e", b"two"]
    whole = hashed_words(texts)
    monkeypatch.setattr(word_hashes, "PART", 7)
    parts = hashed_words(texts)
    assert whole[1].tolist() == parts[1].tolist() == [0, 0, 0, 3, 5, 7, 8]
    for h, _ in (whole, parts):
        assert h[0] == h[2] == h[4] == h[5] and h[1] == h[7] and len(set(h.tolist())) == 4


def plain(docs):
    """(id, bytes) -> id, n_words, n_removed, sha256."""
    first = {}
    split = [(k, t.split()) for k, t in docs]
    for k, words in split:
        for i in range(len(words) - W + 1):
            w = tuple(words[i : i + W])
            first[w] = min(first.get(w, k), k)
    out = []
    for k, words in split:
        gone = set()
        for i in range(len(words) - W + 1):
            if first[tuple(words[i : i + W])] < k:
                gone.update(range(i, i + W))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((k, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    rows = df.collect()
    assert all(a["end"] < b["start"] for r in rows for a, b in zip(r.spans, r.spans[1:]))
    return sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept_text).hexdigest()) for r in rows)


def test_op12_equals_plain_search(spark, folder, documents):
    want = plain([(k, t.encode()) for k, t, _ in documents])
    assert sorted(map(tuple, queries.op12_substring_dedup(spark, folder).collect())) == want and sum(r[2] for r in want) > 5000


@pytest.mark.parametrize("seed, crowded", [(1, 0), (2, 1 << 14), (3, 3)])
def test_planted_passages(spark, seed, crowded, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 200)
    rng = random.Random(seed)
    word = lambda n: [rng.choice("a b cc é 日".split()) if seed == 1 else str(rng.randrange(200)) for _ in range(n)]
    shared = [word(n) for n in (5, 12, 13, 14, 20, 40, 120)]
    docs = []
    for key in range(150):
        words = [w for _ in range(5) for w in (rng.choice(shared) if rng.random() < 0.6 else word(rng.randrange(12)))]
        docs.append((key * 7 % 151, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(200, docs[3][1]), (201, docs[3][1] + " x"), (202, "y " + docs[3][1]), (203, "z " * 400), (199, "z " * 300), (204, ""), (-3, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(substring_dedup.remove_passages(df)) == plain([(k, t.encode()) for k, t in docs])


def test_dirty_rows(spark, dirty):
    rows = [(r.doc_id, (r.text or "").encode()) for r in dirty.collect()]
    dirty = dirty.select("doc_id", "text", "lang", "_hash")
    more = [(12, "word " * 20), (12, "word " * 21), (None, "a b c d e f g h i j k l m n"), (13, "q a b c d e f g h i j k l m"), (1, "word " * 13)]
    df = dirty.unionByName(spark.createDataFrame([(k, t, None, None) for k, t in more], dirty.schema)).withColumnRenamed("lang", "digest")
    every = [(-1 if k is None else k, t) for k, t in rows + [(k, t.encode()) for k, t in more]]
    found = substring_dedup.remove_passages(df).fillna(-1, ["doc_id"])
    assert got(found) == plain(every)
    assert substring_dedup.remove_passages(df.limit(0)).count() == 0
    assert substring_dedup.remove_passages(df.where("doc_id in (2, 3)")).count() == 2
