"""Runs against a plain search for every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import periodic_runs, queries


def plain(words):
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            # A smaller period of the same stretch was met before.
            if length >= max(6, 4 * q) and not any(s == start and e == start + length for s, e in found):
                found[start, start + length] = q
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def made(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abcdefghij" if seed % 3 == 1 else [str(i) for i in range(300)]
    words = []
    for _ in range(rng.randrange(1, 9)):
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 30]))]
        if rng.random() < 0.3:
            unit = unit * rng.randrange(2, 6) + [rng.choice(letters)]
        words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 200)]
        words += [rng.choice(letters) for _ in range(rng.randrange(6))]
    return [w.encode() for w in words]


@pytest.mark.parametrize("chunk", [2, periodic_runs.CHUNK])
def test_runs_of_many_texts(chunk, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    texts = [[], *(made(seed) for seed in range(150)), [b"a"] * 500, [b"a", b"b"] * 40, [], [b"x"]]
    names = {}
    ids = np.array([names.setdefault(w, len(names) + 1) for t in texts for w in t])
    base = np.cumsum([0, *map(len, texts)])
    got = periodic_runs.runs_of(ids, base)
    want = [(b + s, n, q) for t, b in zip(texts, base.tolist()) for s, n, q in plain(t)]
    assert got.tolist() == [list(r) for r in sorted(want, key=lambda r: (r[0], r[2]))] and len(want) > 200


def digests(doc_id, words):
    runs = plain(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()


def test_op13_equals_plain_search(spark, folder, documents):
    want, long = [], 0
    for k, text, _ in documents:
        words = text.encode().split()
        h, n = zlib.crc32(str(k).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want.append(digests(k, words))
        long += bool(want[-1][1])
    got = queries.op13_periodic_runs(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(want) and long > 10
    assert [f for f, _ in queries.op13_periodic_runs(spark, folder).dtypes][1:6] == ["n_runs", "start", "length", "period", "exponent_milli"]


def test_dirty_rows(spark, dirty, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE", 300)
    dirty = dirty.select("doc_id", "text", "lang", "_hash")
    more = [(20, b" ".join(made(s)).decode(), None, None) for s in range(12)]
    df = dirty.unionByName(spark.createDataFrame(more, dirty.schema)).withColumnRenamed("lang", "runs").withColumnRenamed("_hash", "n_words")
    got = periodic_runs.collapse_runs(df).collect()
    want = []
    for r in df.collect():
        words = (r.text or "").encode().split()
        runs = [(0, 60000, 1)] if r.doc_id == 7 else plain(words)
        want.append((r.doc_id, len(words), runs, collapsed(words, runs)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    found = [(r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], bytes(r.kept_text)) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert periodic_runs.collapse_runs(df.limit(0)).count() == 0
