"""Code lengths against a plain trie with escapes and exclusion."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import ppm, queries
from pyspark.sql import functions as F


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [b""]


def plain_trie(words):
    trie = defaultdict(Counter)
    for w, c in words.items():
        padded = b" " * ppm.ORDER + w + b" "
        for i in range(ppm.ORDER, len(padded)):
            for k in range(ppm.ORDER + 1):
                trie[padded[i - k : i]][padded[i]] += c
    return trie


def plain_log(trie, context, symbol):
    total, out = 0.0, set()
    for k in range(len(context) + 1):
        met = {y: c for y, c in trie.get(context[k:], {}).items() if y not in out}
        n, q = sum(met.values()), len(met)
        if symbol in met:
            return total + math.log10((2 * met[symbol] - 1) / (2 * n))
        if n:
            total += math.log10(q / (2 * n))
        out |= set(met)
    return total - math.log10(ppm.ALPHABET - len(trie[b""]))


def plain_word(trie, w):
    padded = b" " * ppm.ORDER + w + b" "
    return sum(plain_log(trie, padded[i - ppm.ORDER : i], padded[i]) for i in range(ppm.ORDER, len(padded)))


def running(words):
    return b"".join(w + b" " for w in words[:-1])


def plain_scores(docs, learned):
    counts, texts = Counter(), Counter()
    for key, text in docs:
        if learned(key):
            counts.update(words_of(text))
            texts[running(words_of(text))] += 1
    trie, n, v = plain_trie(texts), sum(counts.values()), len(counts)
    logs = {}

    def byte(context, symbol):
        if (context, symbol) not in logs:
            logs[context, symbol] = plain_log(trie, context, symbol)
        return logs[context, symbol]

    for key, text in docs:
        ws = words_of(text)
        padded = b" " * ppm.ORDER + running(ws) + b" "
        yield key, len(ws), sum(counts[w] > 0 for w in ws), n, sum(
            math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws
        ), sum(byte(padded[i - ppm.ORDER : i], padded[i]) for i in range(ppm.ORDER, len(padded)))


def test_op5_equals_a_plain_trie(spark, folder, documents):
    want = {r[0]: r[1:] for r in plain_scores([d[:2] for d in documents], lambda k: zlib.crc32(str(k).encode()) % 10 != 0)}
    got = queries.op5_lm_scores(spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], rel=1e-9)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_WORDS", 0.2)
    monkeypatch.setattr(ppm, "HOT_GRAMS", 0.05)
    docs = [(1, "the cat the hat"), (2, "a cat sat"), (3, "été the bat cat zzz"), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.text_scores(df, F.col("doc_id") != 3).collect()}
    for key, n, known, total, base, score in plain_scores(docs, lambda k: k != 3):
        r = got[key]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert (r.base_score, r.score) == pytest.approx((base, score))


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_rare_grams_are_joined(spark, monkeypatch, most):
    passage = " ".join(f"w{i}" for i in range(300))
    docs = [(1, passage), (2, "a cat sat"), (3, f"{passage} unheard"), (4, ""), (5, "a cat sat"), (6, f"{passage} {passage}")]
    docs += [(k, "one and the same line") for k in range(7, 15)] + [(15, "met in no other text"), (16, "one and the same line")]
    held_out = (3, 15, 16)
    want = list(plain_scores(docs, lambda k: k not in held_out))
    monkeypatch.setattr(ppm, "HOT_GRAMS", most)
    monkeypatch.setattr(ppm, "HOT_WORDS", 0.02)
    # Several parts per task, merged and handed on.
    monkeypatch.setattr(ppm, "GRAMS_COUNTED", 100)
    monkeypatch.setattr(ppm, "SLICE", 50)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.text_scores(df, ~F.col("doc_id").isin(*held_out)).collect()}
    for key, n, known, total, base, score in want:
        r = got[key]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert (r.base_score, r.score) == pytest.approx((base, score))


def test_bytes_are_coded_across_words(spark):
    docs = [(k, "new york" if k < 6 else "old town") for k in range(12)]
    docs += [(12, "new york"), (13, "new town"), (14, "york new"), (15, "new\n york")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.text_scores(df, F.col("doc_id") < 12).collect()}
    assert got[12].base_score == pytest.approx(got[13].base_score) and got[12].base_score == pytest.approx(got[14].base_score)
    assert got[12].score > got[13].score + 0.5 and got[12].score > got[14].score + 0.5
    assert got[15].score == pytest.approx(got[12].score)
    # A text that was learned is coded by its bytes too, not by the counts of its words.
    assert got[0].score == pytest.approx(got[12].score) and got[0].score > got[0].base_score + 0.5


def test_packed_columns_come_back_and_are_mostly_zeros():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 30, 5000).astype(np.uint64))
    columns = keys, rng.integers(-3, 1 << 40, len(keys)), rng.random(len(keys))
    bounds = np.array([0, 1, 8, 500, len(keys)])
    for at, to, value in zip(bounds, bounds[1:], ppm.packed(bounds, *columns)):
        key, number, real = ppm.unpacked(pa.scalar(value, pa.binary()), 3)
        assert (key == keys[at:to]).all() and (number.view(np.int64) == columns[1][at:to]).all() and (real.view(float) == columns[2][at:to]).all()
    ones = np.ones(len(keys), np.int64)
    assert len(pa.compress(ppm.packed(bounds[[0, -1]], keys, ones, 0 * ones)[0], "lz4", asbytes=True)) < 5 * len(keys)


def test_grams_of_texts_are_not_exploded(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_GRAMS", 0)
    monkeypatch.setattr(ppm, "SENT", 50)
    monkeypatch.setattr(ppm, "HELD", 50)
    monkeypatch.setattr(ppm, "ROWS_TOGETHER", 2)
    docs = [(k, " ".join(f"w{k * j % 17}" for j in range(40))) for k in range(20)]
    rows = ppm.text_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), F.col("doc_id") % 5 != 0)
    # Words alone are rows of their own.
    assert rows._jdf.queryExecution().sparkPlan().toString().count("Generate explode") == 1
    got = {r.doc_id: r.score for r in rows.collect()}
    want = {r[0]: r[-1] for r in plain_scores(docs, lambda k: k % 5 != 0)}
    assert got == pytest.approx(want)


def test_places():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 5000).astype(np.uint64))
    table = ppm.places(keys[:4000], np.arange(4000.0))
    values, rest = ppm.look_up(table, keys)
    held = np.setdiff1d(np.arange(len(keys)), rest)
    assert len(held) > 3900 and held.max() < 4000 and (values[held] == held).all() and not values[rest].any()
    assert ppm.look_up(ppm.places(keys[:0], np.zeros(0)), keys)[1].tolist() == list(range(len(keys)))


def test_a_context_shares_out_one():
    trie = plain_trie(Counter({b"the": 5, b"then": 2, b"cat": 1, b"": 3}))
    symbols = [b for b in range(256) if b not in b"\t\n\x0b\x0c\r"]
    for context in (b"      ", b"    th", b"  then", b"abcdef"):
        assert sum(10 ** plain_log(trie, context, y) for y in symbols) == pytest.approx(1)


def test_grams():
    gram, begins = ppm.grams_of([b"ab", b"", b"abcdefgh"])
    assert begins.tolist() == [0, 3, 4]
    show = [int(g).to_bytes(7, "big") for g in gram]
    assert show[:4] == [b"      a", b"     ab", b"    ab ", b"       "] and show[-1] == b"cdefgh " and len(show) == 13


def test_dirty_rows(dirty):
    rows = ppm.text_scores(dirty, F.lit(True)).collect()
    assert len(rows) == 11 and all(r.score <= 0 and r.n_known == r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    none = ppm.text_scores(dirty, F.lit(False)).collect()
    assert next(r.score for r in none if r.doc_id == 2) == pytest.approx(-math.log10(ppm.ALPHABET))
    assert ppm.text_scores(dirty.limit(0), F.lit(True)).count() == 0
    assert np.isfinite([r.score for r in none]).all()
