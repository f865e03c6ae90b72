"""Removed bytes against a plain search for every string of 100 bytes."""

import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import queries, suffix_dedup


def plain(docs):
    """(key, bytes) in order -> key, n_bytes, n_removed, n_spans, sha256."""
    seen, out = set(), []
    for key, text in docs:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - 99):
            s = text[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(text) else 0
        out.append((key, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    rows = df.collect()
    return sorted(
        (r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept_text).hexdigest())
        for r in rows
    )


def test_op6_equals_plain_search(spark, folder, documents):
    want = plain(sorted((k, t.encode()) for k, t, _ in documents))
    rows = sorted(map(tuple, queries.op6_suffix_dedup(spark, folder).collect()))
    assert rows == want and sum(r[2] for r in rows) > 10000


def made(seed, letters):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(n) for n in (60, 95, 99, 100, 101, 130, 170, 400)]
    docs = []
    for key in range(120):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else word(rng.randrange(0, 90)) for _ in range(6))
        docs.append((key * 7 % 121, text))
    docs += [(200, docs[3][1]), (201, docs[3][1] + "x"), (202, "y" + docs[3][1]), (203, word(3) * 400), (204, "")]
    return docs


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdefgh "), (3, "éß日x"), (4, "a")])
def test_planted_passages(spark, seed, letters, monkeypatch):
    docs = made(seed, letters)
    if seed == 2:
        monkeypatch.setattr(suffix_dedup, "SLICE", 150)
        monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(suffix_dedup.remove_repeats(df)) == plain(sorted((k, t.encode()) for k, t in docs))


def test_multikey_order():
    rng = np.random.default_rng(5)
    strings = rng.integers(97, 99, (500, 20)).astype(np.uint8)
    strings[rng.integers(0, 500, 200)] = strings[0]
    tie = rng.permutation(500)
    order, again = suffix_dedup.multikey_order(strings, tie)
    rows = [strings[i].tobytes() for i in range(500)]
    assert order.tolist() == sorted(range(500), key=lambda i: (rows[i], tie[i]))
    assert again.tolist() == [k > 0 and rows[order[k]] == rows[order[k - 1]] for k in range(500)]


def test_dirty_rows(dirty):
    rows = suffix_dedup.remove_repeats(dirty).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert by[2].n_bytes == 0 and by[2].spans == [] and by[2].kept_text == b""
    assert len(by[7].kept_text) < 120 and len(by[8].kept_text) <= 100
    assert all(r.spans == [] for r in rows if r.doc_id == 4)
    assert suffix_dedup.remove_repeats(dirty.limit(0)).count() == 0
