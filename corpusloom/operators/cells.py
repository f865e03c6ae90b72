"""Approximate search between two large sides: trained cells, lists of vectors per cell, exact scores.

Centres are trained on a bounded sample; every vector of the corpus is put on the
list of its nearest centre, and a query is compared with the lists of the few
centres nearest to it. Scores are exact, so what is found is ranked rightly;
what lies on other lists is missed. :func:`corpusloom.operators.similarity.topk` is
the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import similarity as sim
from corpusloom.operators.similarity import unit_matrix

# Rows that centres are trained on, and the most centres: with them what the driver holds is bounded.
SAMPLE_ROWS = 65_536
MOST_CELLS = 4096
ROUNDS = 12


def train_cells(corpus: DataFrame, cells: int | None = None, id_: str = "chunk_id", vec: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres as unit rows, by spherical k-means over the rows with the smallest hashes of their id.

    Without ``cells`` there are about as many as the square root of the corpus'
    rows. The same corpus gives the same centres. An empty corpus gives none.
    """
    wanted = cells or max(1, isqrt(corpus.count()))
    sample = corpus.select(F.col(id_).alias("id"), F.col(vec).alias("vec")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    unit = unit_matrix(sample.toArrow().column("vec"))
    unit = unit[(unit * unit).sum(1) > 0.5] if len(unit) else unit
    if not len(unit):
        return np.zeros((0, 0))
    centres = np.unique(unit, axis=0)
    step = max(1, len(centres) // min(wanted, MOST_CELLS))
    centres = centres[::step][: min(wanted, MOST_CELLS)]
    for _ in range(ROUNDS):
        home = np.concatenate([(unit[at : at + 4096] @ centres.T).argmax(1) for at in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        # A centre that nothing is nearest to stays where it is.
        moved = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def _near_cells(side: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """The rows once for each of their ``probes`` nearest centres, whose number is ``cell``."""
    held = side.sparkSession.sparkContext.broadcast(centres)
    probes = min(probes, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(unit_matrix(batch["vec"]) @ held.value.T), axis=1, kind="stable")[:, :probes]
                picked = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), probes)))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *picked.columns], names=["cell", *batch.schema.names])

    return side.mapInArrow(run, T.StructType([T.StructField("cell", T.IntegerType()), *side.schema.fields]))


def cell_lists(corpus: DataFrame, centres: np.ndarray, id_: str = "chunk_id", vec: str = "embedding") -> DataFrame:
    """``cell, id, ord, vec``: every row of the corpus on the list of its nearest centre, to be stored by ``cell``."""
    return _near_cells(sim._side(corpus, id_, vec, None), centres, 1)


def topk_in_cells(
    queries: DataFrame,
    lists: DataFrame,
    centres: np.ndarray,
    k: int = 5,
    probes: int = 8,
    threshold: float | None = None,
    query_id: str = "query_id",
    corpus_id: str = "chunk_id",
    vec: str = "embedding",
    limits: sim.Limits = sim.Limits(),
) -> DataFrame:
    """The k most similar rows per query among the lists of its ``probes`` nearest centres, best first, ties by id.

    ``lists`` are those of :func:`cell_lists`, a stored table. A crowded list is cut into tiles, of
    which each hands on at most k rows per query. With as many probes as centres
    the result is exact.
    """
    schema = T.StructType(
        [T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(corpus_id, lists.schema["id"].dataType), T.StructField("score", T.DoubleType())]
    )
    if not len(centres):
        hits = lists.sparkSession.createDataFrame([], schema)
    else:
        asked = _near_cells(sim._side(queries, query_id, vec, None), centres, probes)
        # One number per centre for either side.
        hits = sim._tiled(asked, lists, sim._cell_counts(asked), sim._cell_counts(lists), sim._best_kernel(k, threshold, False), schema, limits)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), F.col(corpus_id)))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)
