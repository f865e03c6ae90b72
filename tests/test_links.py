"""Leaders from sparse links against the sequential rule."""

import numpy as np
import pytest
import reference_rules as rules

from corpusloom.operators import links, resolution
from corpusloom.operators import similarity as sim
from corpusloom.session import cut_lineage


def frame(spark, vectors, name="ord"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return cut_lineage(spark.createDataFrame(rows, f"{name} long, vec array<float>").repartition(3))


def clusters(n, centres, spread, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


def leaders_of(vectors, threshold):
    return {i for i, leader in enumerate(rules.resolve(vectors, threshold)) if i == leader}


# Tight groups, groups whose members are often apart, and vectors without any group.
@pytest.mark.parametrize("spread, threshold, tiles", [(0.02, 0.92, False), (0.25, 0.9, True), (0.35, 0.75, False), (3.0, 0.35, False)])
def test_leaders_equal_arrival_order(spark, spread, threshold, tiles):
    v = clusters(400, 12, spread, seed=int(100 * spread))
    limits = sim.Limits(broadcast_rows=0, tile_rows=128, pivots=8) if tiles else sim.Limits()
    got = links.linked_leaders(frame(spark, v), threshold, limits)
    assert {r.ord for r in got.collect()} == leaders_of(v, threshold)


def test_small_buckets_and_missed_links(spark, monkeypatch):
    """Parts of four rows see few of their leaders; the proof finds the rest."""
    monkeypatch.setattr(links, "BUCKET_ROWS", 4)
    v = clusters(200, 5, 0.15, seed=8)
    got = links.linked_leaders(frame(spark, v), 0.9)
    assert {r.ord for r in got.collect()} == leaders_of(v, 0.9)


def test_chain_of_links(spark):
    """Each row is similar to its neighbours only: every third or so leads."""
    angles = np.arange(0, 2.2, 0.21)
    v = np.c_[np.cos(angles), np.sin(angles)]
    for order in (slice(None), slice(None, None, -1)):
        got = links.linked_leaders(frame(spark, v[order]), 0.92, finish_links=4)
        assert {r.ord for r in got.collect()} == leaders_of(v[order], 0.92)


def test_followers_by_rounds_and_in_order(spark):
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 80, (150, 2)).tolist() if p[0] != p[1]}
    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    want: set[int] = set()
    for i in range(80):
        if any(b == i and a not in want for a, b in pairs):
            want.add(i)
    for finish in (10, 1 << 20):
        assert {r.ord for r in links.followers(df, finish).collect()} == want
    assert links.followers(df.limit(0)).count() == 0


def test_separated_vectors_need_few_comparisons(spark):
    """Rows after the first ones, in 60 tight groups: a small part of all pairs is compared."""
    n = 6000
    v = clusters(n, 60, 0.03, seed=5)
    compared = spark.sparkContext.accumulator(0)
    got = links.linked_leaders(frame(spark, v), 0.92, compared=compared)
    assert {r.ord for r in got.collect()} == leaders_of(v, 0.92)
    assert 0 < compared.value < 0.1 * n * n / 2


def test_resolution_beyond_the_first_rows(spark):
    v = clusters(500, 40, 0.2, seed=6)
    df = frame(spark, v).withColumnRenamed("vec", "embedding")
    got = resolution.resolve_entities(df, 0.85, finish_rows=50)
    assert {r.ord: r.leader_ord for r in got.collect()} == dict(enumerate(rules.resolve(v, 0.85)))
    assert resolution.resolve_entities(df.limit(0), 0.85).count() == 0
