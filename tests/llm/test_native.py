"""Exact dedup, quality rules and mixing against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import exact_dedup, hashed, mixing, quality_rules, queries
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def plain_ratio(docs, trusted, buckets, spark):
    """doc key -> mean log ratio; buckets by Spark's hash of the same strings."""
    tokens = {k: re.findall(r"[^\W\d_]+|(?:(?![^\W\d_])\S)+", t or "") for k, t in docs}
    grams = {k: [(a,) for a in ts] + list(zip(ts, ts[1:])) for k, ts in tokens.items()}
    every = sorted({g for gs in grams.values() for g in gs})
    rows = spark.createDataFrame([(i, g[0], g[1] if len(g) > 1 else None) for i, g in enumerate(every)], "i int, a string, b string")
    h = F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b"))
    of = {every[r.i]: r.h for r in rows.select("i", F.pmod(h, F.lit(buckets)).alias("h")).collect()}
    raw, target = Counter(), Counter()
    for k, gs in grams.items():
        raw.update(of[g] for g in gs)
        if k in trusted:
            target.update(of[g] for g in gs)
    n, m = sum(raw.values()) + 0.5 * buckets, sum(target.values()) + 0.5 * buckets
    score = {b: math.log((target[b] + 0.5) / m / ((raw[b] + 0.5) / n)) for b in raw}
    return {k: sum(score[of[g]] for g in gs) / len(gs) if gs else 0.0 for k, gs in grams.items()}


def test_op8_equals_plain_counts(spark, folder, documents):
    trusted = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    ratio = plain_ratio([d[:2] for d in documents], trusted, hashed.BUCKETS, spark)
    texts = {k: t for k, t, _ in documents}
    got = queries.op8_quality_rules(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert r.llr == pytest.approx(ratio[r.doc_id], abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= r.threshold)
    below = sum(r.llr < r.threshold for r in got if r.doc_id in trusted)
    assert below <= quality_rules.TRUSTED_LOSS * len(trusted)


def test_repeated_windows(spark):
    texts = [" ".join(map(str, x)) for x in ([*range(8), *range(8)], [1] * 30, [*range(7)] * 2, [*range(20), 5, *range(3, 12)], [])]
    texts += ["a\nb\na\n \n\n b\nb", None, "x# |<>$ 　 y\x0bz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = quality_rules.base_columns(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(t)


def test_rules_on_dirty_rows(spark, dirty):
    trusted = spark.createDataFrame([(4,), (4,), (None,), (99,)], "doc_id long")
    got = quality_rules.quality_verdicts(dirty, trusted).collect()
    assert len(got) == 11 and {r.kept for r in got if r.doc_id in (1, 2, 3)} == {False}
    none = quality_rules.quality_verdicts(dirty, trusted.limit(0)).collect()
    assert {r.llr for r in none} == {0.0} and {r.threshold for r in none} == {0.0}
    assert quality_rules.quality_verdicts(dirty.limit(0), trusted).count() == 0


def test_exact_dedup_on_dirty_rows(dirty):
    got = exact_dedup.exact_duplicates(dirty).collect()
    assert len(got) == 11
    four = [r for r in got if r.doc_id in (4, 5)]
    assert all(r.keep_id == 4 and r.group_size == 3 and r.kept == (r.doc_id == 4) for r in four)
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert all(r.keep_id == 1 and r.text_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
    left = exact_dedup.deduplicate(dirty)
    assert left.columns == dirty.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4, 6, 7, 8, 9]
    assert exact_dedup.exact_duplicates(dirty.limit(0)).count() == exact_dedup.deduplicate(dirty.limit(0)).count() == 0


@pytest.mark.parametrize("hasher", [lambda t: F.lit(b"x"), lambda t: F.length(t), exact_dedup.content_hash])
def test_colliding_hashes_are_told_apart_by_their_bytes(spark, hasher):
    docs = [(i, f"text {i % 7 if i % 3 else 'AbC'}") for i in range(60)] + [(100, "only"), (101, "é"), (102, "É")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    groups = defaultdict(list)
    for k, t in docs:
        groups["".join(c.lower() if c.isascii() else c for c in t)].append(k)
    want = sorted((k, max(g), len(g), k == max(g)) for g in groups.values() for k in g)
    got = exact_dedup.exact_duplicates(df, keep="largest", hasher=hasher).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.3, 0.3], 500)
    n = rng.integers(0, 900, 500)
    rows = [(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    own = n @ p
    for factor in ([1.2, 0.5, 0.3], [1, 1, 1], [1.6, 0.4, 0.8]):
        goal = own * np.array(factor)
        got = mixing.document_rates(members, goal.tolist()).orderBy("doc_id").collect()
        rate = np.array([r.rate for r in got])
        assert (rate >= 0).all() and np.abs((n * rate) @ p - goal).max() < 2e-4 * n.sum()


def test_rates_stay_within_their_bounds(spark):
    rng = np.random.default_rng(3)
    p = np.vstack([rng.dirichlet([9, 0.5, 0.5], 300), rng.dirichlet([0.3, 2, 1], 300)])
    n = rng.integers(1, 900, 600)
    members = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
    got = mixing.document_rates(members, [80, 13, 7], anchor=0, most=1).orderBy("doc_id").collect()
    rate = np.array([r.rate for r in got])
    assert rate.min() >= 0 and rate.max() <= 1 and (rate[p[:, 0] >= 0.5] == 1).all()
    totals = (n * rate) @ p
    assert totals / totals.sum() == pytest.approx([0.8, 0.13, 0.07], abs=0.002)


def test_op1_matches_its_weights(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op1_mixing(spark, folder).collect()
    assert len(rows) == 1000 and {r.copies for r in rows} <= {0, 1}
    total = sum(r.n_tokens * r.rate for r in rows)
    for name, share in queries.MIXTURE.items():
        assert sum(r.n_tokens * r.rate * r[f"p_{name}"] for r in rows) / total == pytest.approx(share, abs=0.002)
    # What is given out has the shares too, but for the chance of single documents.
    found = mixing.mixed(spark.read.parquet(f"{folder}/documents.parquet"), queries.domain_labels(spark.read.parquet(f"{folder}/labels.parquet")), **queries.MIX)
    for by, apart in (("rate", 0.002), ("copies", 0.012)):
        for r in mixing.shares(found, queries.MIXTURE, by).collect():
            assert r.share == pytest.approx(r.wanted, abs=apart)
    known = {r.doc_id: r.domain for r in queries.domain_labels(spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    clean = [r for r in rows if known.get(r.doc_id) == "clean"]
    assert sum(r.copies for r in clean) >= 0.97 * len(clean)


def test_a_domain_with_too_little_text_leaves_the_others_alone(spark):
    """Twenty low texts among two thousand clean ones can't be a twentieth; no clean text goes for it."""
    rng = np.random.default_rng(7)
    word = lambda k: " ".join(f"{k}{rng.integers(0, 40)}" for _ in range(60))
    rows = [(i, word("c" if i % 100 else "l")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "clean" if i % 100 else "low") for i in range(0, 2000, 4)], "doc_id long, domain string")
    got = mixing.mixed(docs, labels, **queries.MIX).collect()
    assert all(r.copies == 1 for r in got if r.doc_id % 100)
    assert sum(r.copies for r in got if r.doc_id % 100 == 0) >= 15


def test_mixing_on_dirty_rows(spark, dirty):
    labels = spark.createDataFrame([(4, "a"), (4, "b"), (6, "b"), (None, "a"), (7, "z"), (8, None)], "doc_id long, domain string")
    weights = {"a": 0.5, "b": 0.5}
    got = mixing.mixed(dirty, labels, weights).collect()
    assert len(got) == 11 and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in got)
    assert mixing.mix(dirty, labels, weights, most_copies=1).columns == dirty.columns
    assert {r.rate for r in mixing.mixed(dirty, labels.limit(0), weights).collect()} == {1.0}
    assert mixing.mixed(dirty.limit(0), labels, weights).count() == 0
