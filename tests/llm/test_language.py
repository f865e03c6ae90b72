"""Language proportions against a plain statement of the same mixture, and held-out languages."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import language, queries
from pyspark.sql import functions as F


def bucket(four):
    return int.from_bytes(four, "big") * 2654435761 % 2**32 >> 16


def words_of(text):
    """Byte 4-grams of each word, those at the space before it included."""
    data = b" " + text.lower().encode() + b" "
    out = []
    for i in range(len(data) - 3):
        if i == 0 or data[i] <= 32:
            out.append([])
        out[-1].append(bucket(data[i : i + 4]))
    return [w for w in out if w]


def plain_pick(text, counts, names):
    total = {k: sum(counts[k].values()) + language.SMOOTHING * language.BUCKETS for k in names}
    rows = []
    for w in words_of(text):
        logs = [sum(math.log((counts[k][g] + language.SMOOTHING) / total[k]) for g in w) for k in names]
        rows.append([math.exp(x - max(logs)) + language.FLOOR for x in logs])

    def fit(allowed):
        w = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(names))]
        for _ in range(language.ROUNDS):
            new = [0.0] * len(w)
            for r in rows:
                s = sum(a * b for a, b in zip(r, w))
                new = [n + a * b / s for n, a, b in zip(new, r, w)]
            w = [n / len(rows) for n in new]
        return w, sum(math.log(sum(a * b for a, b in zip(r, w))) for r in rows)

    full, _ = fit(range(len(names)))
    order = sorted(range(len(names)), key=lambda k: -full[k])
    best = None
    for size in range(1, min(language.MOST_LANGUAGES, len(names)) + 1):
        w, ll = fit(order[:size])
        value = ll - (size - 1) * 0.5 * math.log(max(len(rows), 2))
        if best is None or value > best[0]:
            best = (value, w)
    top = max(best[1])
    return names[best[1].index(top)], top


def test_mixture_equals_plain_python(spark, documents):
    rows = [(k, t[:1500], lang) for k, t, lang in documents[:60]]
    rows += [(1000, rows[0][1][:400] + " " + next(t for _, t, lang in rows if lang == "en")[:600], None)]
    counts = defaultdict(Counter)
    for k, t, lang in rows:
        if k % 3 and lang:
            for w in words_of(t):
                counts[lang].update(w)
    names = sorted(counts)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in language.identify(docs, F.col("doc_id") % 3 != 0).collect()}
    for k, t, _ in rows:
        want, share = plain_pick(t, counts, names)
        assert got[k].lang_pred == want and got[k].score == pytest.approx(share, abs=2e-3)
    assert len(got[1000].languages) == 2


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7])
def test_a_text_keeps_all_its_languages(n):
    k = 8
    words = np.tile(np.eye(k)[:n], (50, 1)) + language.FLOOR
    alone = np.tile(np.eye(k)[:1], (40, 1)) + language.FLOOR
    of = np.r_[np.zeros(40, int), np.full(len(words), 2), np.full(40, 3)]
    weights = language.choose(np.r_[alone, words, alone], of, 4)
    for text, found in ((0, 1), (2, n), (3, 1)):
        assert (weights[text] > 0).nonzero()[0].tolist() == list(range(found))
        assert weights[text][:found] == pytest.approx(np.full(found, 1 / found), abs=1e-3)


def test_op7_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op7_language(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(known) and len(held) > 200
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.98 * len(held)


def test_dirty_rows(dirty):
    got = {r.doc_id: r for r in language.identify(dirty, F.lit(True)).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[2].score == 0
    assert all(got[k].lang_pred in ("x", "y", "z") for k in (4, 5, 6, 7, 8, 9))
    assert {r.lang_pred for r in language.identify(dirty, F.lit(False)).collect()} == {"und"}
    assert language.identify(dirty.limit(0), F.lit(True)).count() == 0
    assert re.match("[xyz]", got[8].lang_pred)
