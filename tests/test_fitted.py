"""The fitted embedder against a dense factorisation."""

import random
import tracemalloc
from collections import Counter

import numpy as np

from corpusloom.checks.queries import REGISTRY
from corpusloom.operators import documents, fitted
from corpusloom.operators import embedding as emb

BUCKETS = 512


def topics(n, seed=1):
    rng = random.Random(seed)
    pools = [[f"t{k}w{i}" for i in range(40)] for k in range(6)]
    return [" ".join(rng.choice(pools[i % 6]) if rng.random() < 0.7 else f"Common{rng.randrange(30)}" for _ in range(rng.randrange(5, 60))) for i in range(n)]


def dense(texts):
    """Plain TF-IDF; only the bucket of a word is taken from the library."""
    rows = np.zeros((len(texts), BUCKETS))
    for i, t in enumerate(texts):
        for word, n in Counter(t.lower().split()).items():
            rows[i, fitted.word_counts([word], BUCKETS).bucket[0]] += n
    idf = np.log((1 + len(texts)) / (0.5 + (rows > 0).sum(0)))
    rows = np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0) * idf
    return idf, rows / np.maximum(np.sqrt((rows**2).sum(1, keepdims=True)), 1e-300)


def test_axes_span_those_of_the_dense_factorisation(spark):
    texts = topics(600)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    model = fitted.fit(df, dim=5, buckets=BUCKETS, passes=5, balance=0)
    idf, rows = dense(texts)
    assert np.allclose(model.idf, idf)
    _, strength, axes = np.linalg.svd(rows, full_matrices=False)
    assert np.allclose(model.axes.T @ model.axes, np.eye(5), atol=1e-9)
    assert np.allclose(((rows @ model.axes) ** 2).sum(0), strength[:5] ** 2, rtol=1e-3)
    assert np.abs(np.linalg.svd(axes[:5] @ model.axes)[1] - 1).max() < 1e-2
    want = rows @ model.axes
    want /= np.sqrt((want**2).sum(1, keepdims=True))
    assert np.allclose(fitted.embedder(model)()(texts), want, atol=1e-9)
    # Texts of one topic are nearer to each other than to those of others.
    near = want @ want.T
    same = np.equal.outer(np.arange(600) % 6, np.arange(600) % 6)
    assert near[same].mean() > near[~same].mean() + 0.3
    balanced = fitted.fit(df, dim=5, buckets=BUCKETS, passes=5)
    assert np.allclose(((rows @ balanced.axes) ** 2).sum(0), strength[:5], rtol=1e-3)


def test_the_same_rows_give_the_same_model(spark):
    df = spark.createDataFrame([(t,) for t in topics(300, 3)], "text string")
    one = fitted.fit(df.coalesce(1), dim=8, buckets=BUCKETS)
    two = fitted.fit(df.orderBy("text").repartition(7), dim=8, buckets=BUCKETS)
    assert (one.idf == two.idf).all() and (one.axes == two.axes).all()


def test_products_are_made_by_slabs_that_fit_a_cache():
    entries = fitted.word_counts([" ".join(f"w{i * j}" for j in range(700)) for i in range(1, 101)])
    axes = np.random.default_rng(1).standard_normal((fitted.BUCKETS, 80))
    weight = fitted.weights(entries, np.ones(fitted.BUCKETS))
    assert len(entries.bucket) > 50_000
    tracemalloc.start()
    got = fitted.projected(entries, weight, axes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20
    whole = np.zeros((100, fitted.BUCKETS))
    whole[entries.owner, entries.bucket] = weight
    assert np.allclose(got, whole @ axes)


def test_odd_texts(spark):
    odd = [None, "", " \t\n", "One", "one ONE one", "x" * 100_000, "a " * 50_000, "\ud800 b", "É é"]
    df = spark.createDataFrame([(t,) for t in odd if t != "\ud800 b"], "text string")
    embed = fitted.embedder(fitted.fit(df, dim=4, buckets=BUCKETS))()
    got = embed([t or "" for t in odd])
    assert got.shape == (9, 4) and np.isfinite(got).all()
    assert (got[:3] == 0).all() and np.allclose(got[3], got[4])
    none = fitted.fit(df.limit(0), dim=4, buckets=BUCKETS)
    assert (none.axes == 0).all() and (fitted.embedder(none)()(["a", ""]) == 0).all()
    assert embed([]).shape == (0, 4)
    # Slabs of any size give the same counts and components.
    whole = fitted.word_counts(topics(50), BUCKETS)
    each = [fitted.word_counts([t], BUCKETS) for t in topics(50)]
    assert whole.bucket.tolist() == [b for e in each for b in e.bucket.tolist()]
    assert whole.count.sum() == sum(len(t.split()) for t in topics(50))


def test_passages_are_found_better_than_by_hashing(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    passages = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()]
    chunks = documents.chunks(docs).select("doc_id", "text")
    held = [r.text for r in chunks.orderBy("doc_id", "text").collect()]
    flat = [" ".join(t.split()) for t in held]
    asked = [p for p in passages if any(" ".join(p.split()) in t for t in flat)]
    model = fitted.fit(chunks, dim=64)

    def found(load):
        near = load(asked) @ load(held).T
        return [" ".join(p.split()) in flat[i] for p, i in zip(asked, near.argmax(1))]

    by_words, by_grams = sum(found(fitted.embedder(model)())), sum(found(emb.gram_hashing(64)()))
    assert len(asked) >= 10 and by_words > by_grams, (by_words, by_grams, len(asked))


def test_registered_query(spark, folder):
    rows = REGISTRY["embed_text_fitted"](spark, folder).collect()
    assert len(rows) == REGISTRY["chunks"](spark, folder).count()
    for r in rows[:50]:
        length = sum((int(x) / 10_000) ** 2 for x in r.embedding.split(","))
        assert abs(length - 1) < 0.01 or length == 0
