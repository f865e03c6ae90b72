import numpy as np
import pyarrow as pa
import pytest

import reference_rules as rules
from corpusloom.operators import embedding as emb
from corpusloom.operators import resolution
from corpusloom.operators import similarity as sim

BROADCAST = sim.Limits()
ONE_CELL = sim.Limits(broadcast_rows=0, tile_rows=32, pivots=1)
CELLS = sim.Limits(broadcast_rows=0, tile_rows=16, pivots=12)
WAYS = pytest.mark.parametrize("limits", [BROADCAST, ONE_CELL, CELLS], ids=["broadcast", "one-cell", "cells"])


def clustered(n=150, dim=8, seed=3):
    """Tight clusters, a third of all rows equal, some loose rows."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    out = centres[rng.integers(0, 6, n)] + 0.15 * rng.standard_normal((n, dim))
    out[rng.permutation(n)[: n // 3]] = centres[0]
    out[rng.permutation(n)[:20]] = rng.standard_normal((20, dim))
    return out.astype(np.float32)


def frame(spark, vectors, name="vec_id"):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, embedding array<float>"
    ).repartition(5)


@WAYS
@pytest.mark.parametrize("threshold", [0.2, 0.9, 0.97])
def test_pairs_equal_brute_force(spark, limits, threshold):
    v = clustered()
    s = rules.cosines(v)
    want = {(i, j): s[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= threshold}
    got = sim.similar_pairs(frame(spark, v), threshold, limits=limits).collect()
    assert len(got) == len(want)
    assert {(r.id_a, r.id_b): r.score for r in got} == pytest.approx(want, abs=2e-9)


def test_cells_leave_tiles_out(spark):
    v = clustered(400)
    side = sim._side(frame(spark, v), "vec_id", "embedding", "vec_id")
    _, _, home, reached = sim._in_cells(side, side, 0.97, CELLS)
    assert len(home) > 1
    assert sum(n * reached.get(c, 0) for c, n in home.items()) < 0.5 * 400 * 400


@WAYS
def test_join_of_two_tables(spark, limits):
    a, b = clustered(40, seed=1), clustered(60, seed=2)
    both = rules.cosines(np.vstack([a, b]))[:40, 40:]
    got = sim.similarity_join(
        frame(spark, a, "query_id"), frame(spark, b, "chunk_id"), 0.4, limits=limits
    ).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(i, j) for i, j in zip(*np.nonzero(both >= 0.4))}


@WAYS
@pytest.mark.parametrize("k,threshold", [(1, None), (5, None), (3, 0.75), (500, 0.1)])
def test_topk_equals_brute_force(spark, limits, k, threshold):
    q, c = clustered(30, seed=5), clustered(120, seed=6)
    s = rules.cosines(np.vstack([q, c]))[:30, 30:]
    got = {}
    rows = sim.topk(frame(spark, q, "query_id"), frame(spark, c, "chunk_id"), k, threshold, limits=limits)
    for r in rows.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    for i in range(30):
        ranked = sorted((j for j in range(120) if threshold is None or s[i, j] >= threshold), key=lambda j: (-s[i, j], j))
        assert sorted(got.get(i, [])) == [(n + 1, j) for n, j in enumerate(ranked[:k])]


def test_a_task_hands_on_few_rows_of_many_copies():
    q = np.eye(4)[:2]
    right = (np.arange(1000), np.zeros(1000), np.tile(np.eye(4)[0], (1000, 1)))
    kernel = sim._best_kernel(3, None, False)(True)
    left = (np.arange(2), np.zeros(2), q)
    sent = [sum(len(x[0]) for x in kernel(left, right)) for _ in range(4)]
    assert all(n <= 6 for n in sent)


@pytest.mark.parametrize(
    "limits,finish_rows,threshold",
    [
        (BROADCAST, 4096, 0.92),
        (BROADCAST, 8, 0.5),
        (BROADCAST, 8, 0.92),
        (BROADCAST, 8, 0.99),
        (ONE_CELL, 8, 0.92),
        (CELLS, 8, 0.92),
    ],
)
def test_resolution_equals_arrival_order(spark, limits, finish_rows, threshold):
    v = clustered(90, seed=11)
    want = rules.resolve(v, threshold)
    got = resolution.resolve_entities(
        frame(spark, v), threshold, order="vec_id", finish_rows=finish_rows, limits=limits
    ).collect()
    assert len(got) == len(v)
    assert {r.vec_id: r.leader_vec_id for r in got} == dict(enumerate(want))
    leaders = {r.leader_vec_id for r in got}
    assert all(r.score >= threshold for r in got)
    s = rules.cosines(v)
    assert all(s[i, j] < threshold for i in leaders for j in leaders if i < j)


@WAYS
def test_resolution_goes_on_from_a_store(spark, limits):
    v = clustered(90, seed=4)
    want = dict(enumerate(rules.resolve(v, 0.92)))
    table = frame(spark, v)
    early, late = table.where("vec_id < 40"), table.where("vec_id >= 40")
    first = resolution.resolve_entities(early, 0.92, order="vec_id", limits=limits)
    stored = early.join(first.where("vec_id = leader_vec_id").select("vec_id"), "vec_id")
    second = resolution.resolve_entities(late, 0.92, order="vec_id", stored=stored, limits=limits)
    assert {r.vec_id: r.leader_vec_id for r in first.unionByName(second).collect()} == want


def test_chains_are_kept_apart(spark):
    """a~b and b~c but not a~c; d is closer to the later leader c than to a."""
    angles = [0.0, 0.35, 0.7, 0.45]
    v = [[np.cos(a), np.sin(a)] for a in angles]
    got = resolution.resolve_entities(frame(spark, v), 0.92, order="vec_id").collect()
    assert {r.vec_id: r.leader_vec_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_banded_join_finds_most_and_nothing_wrong(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    exact = {(r.id_a, r.id_b) for r in sim.similar_pairs(table, 0.3).collect()}
    bands = sim.SignBands.for_recall(0.3, 0.95, bits=4)
    rows = sim.similar_pairs_banded(table, 0.3, bands, limits=sim.Limits(tile_rows=64)).collect()
    found = {(r.id_a, r.id_b) for r in rows}
    assert len(rows) == len(found) and found <= exact
    assert len(found) >= 0.9 * len(exact)


def test_embedder_contract(spark):
    texts = ["", "a", "abc", "Grüße 😀", "abc", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    got = {r.i: np.array(r.embedding) for r in emb.embed_text(df, loader=emb.gram_hashing(32)).collect()}
    assert all(len(v) == 32 for v in got.values())
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-6 for i in range(1, 6)) and not got[0].any()
    assert (got[2] == got[4]).all()


def test_embedder_is_pluggable(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "i long, text string")
    rows = emb.embed_text(df, loader=lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert {r.i: r.embedding for r in rows} == {1: [2.0, 1.0], 2: [4.0, 1.0]}


def test_vectors_without_direction_lead_themselves(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.01]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "ord long, embedding array<float>")
    got = {r.ord: r.leader_ord for r in resolution.resolve_entities(df, 0.9).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5}


@pytest.mark.parametrize("vectors", [[[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], None], [[1.0, 2.0], [3.0, 4.0, 5.0, 6.0]], [[1.0, None]]])
def test_null_and_ragged_vectors_are_refused(vectors):
    with pytest.raises(ValueError, match="vectors must not be null"):
        sim.unit_matrix(pa.array(vectors, pa.list_(pa.float32())))


def test_pairs_of_text_ids(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0])], "vec_id string, embedding array<float>")
    for limits in (sim.Limits(), sim.Limits(broadcast_rows=0)):
        got = sim.similar_pairs(df, 0.9, limits=limits).collect()
        assert [(r.id_a, r.id_b) for r in got] == [("a", "b")]


def test_rows_are_not_copied_once_per_small_tile():
    """What is sent to tiles must not grow with the square of the rows."""
    tiny = sim.Limits(broadcast_rows=0, tile_rows=128, pivots=8)
    copies = [sim._stripes(n, 1, tiny) for n in (128, 2_000, 20_000, 100_000)]
    assert copies == [1, 8, 8, 8]
    assert all(n / sim._stripes(n, 1, tiny) <= sim.STRIPE_ROWS for n in (1 << k for k in range(24)))
    assert sim._stripes(1_000, 64, tiny) == 1


def test_copies_for_cells_are_made_by_the_slab(spark):
    """A batch of rows that reach every cell is not held that many times over."""
    assert [b.num_rows for b in sim._slabs(iter([pa.record_batch({"x": range(1200)}), pa.record_batch({"x": pa.array([], pa.int64())})]))] == [512, 512, 176]
    v = clustered(600)
    side = sim._side(frame(spark, v), "vec_id", "embedding", "vec_id")
    pivots = sim.unit_matrix(pa.array([list(map(float, x)) for x in np.eye(8)]))
    assert sim._cell_counts(sim._assign(side, pivots, 10.0)) == {c: 600 for c in range(8)}
