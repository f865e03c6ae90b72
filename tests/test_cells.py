"""Search in cells against the exact search."""

import numpy as np

from corpusloom.checks.queries import REGISTRY
from corpusloom.operators import cells
from corpusloom.operators import similarity as sim
from corpusloom.session import cut_lineage


def frame(spark, vectors, name):
    return cut_lineage(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, embedding array<float>"))


def found(rows):
    return {(r.query_id, r.rank, r.chunk_id) for r in rows.collect()}


def test_recall_and_exactness(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(40, 16))
    corpus = frame(spark, middle[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16)), "chunk_id")
    asked = frame(spark, middle[rng.integers(0, 40, 200)] + 0.4 * rng.normal(size=(200, 16)), "query_id")
    centres = cells.train_cells(corpus)
    assert centres.shape == (54, 16) and np.allclose((centres**2).sum(1), 1)
    assert (centres == cells.train_cells(corpus.repartition(7))).all()
    lists = cut_lineage(cells.cell_lists(corpus, centres))
    assert lists.count() == 3000 and lists.select("id").distinct().count() == 3000
    exact = found(sim.topk(asked, corpus, 5))
    some = found(cells.topk_in_cells(asked, lists, centres, 5, probes=8))
    assert len(some) == 1000 and len({x[::2] for x in some} & {x[::2] for x in exact}) >= 0.9 * len(exact)
    # All lists, and lists cut into tiles, give the exact answer.
    assert found(cells.topk_in_cells(asked, lists, centres, 5, probes=54, limits=sim.Limits(tile_rows=32))) == exact


def test_small_and_odd_corpora(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    asked = frame(spark, [[1.0, 0.0], [0.0, 0.0]], "query_id")
    centres = cells.train_cells(none)
    lists = spark.createDataFrame([], "cell int, id long, ord long, vec array<float>")
    assert len(centres) == 0 and cells.topk_in_cells(asked, lists, centres).count() == 0
    few = frame(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 0.0]], "chunk_id")
    centres = cells.train_cells(few, cells=9)
    lists = cut_lineage(cells.cell_lists(few, centres))
    got = cells.topk_in_cells(asked, lists, centres, 2, threshold=0.5).collect()
    assert [(r.query_id, r.rank, r.chunk_id) for r in sorted(got)] == [(0, 1, 0), (0, 2, 1)]


def test_registered_query_finds_most(spark, folder):
    got = {(r.query_id, r.vec_id) for r in REGISTRY["topk_in_cells"](spark, folder).collect()}
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    asked = table.withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in sim.topk(asked, table, 3, corpus_id="vec_id").collect()}
    assert len(got) == 1500 and len(got & exact) >= 0.9 * len(exact)
