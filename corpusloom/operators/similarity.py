"""Exact cosine search and similarity joins.

Two ways to the same rows:

* one side is small (its size is *checked*, never assumed): that side is
  broadcast as one matrix and the other side is scanned once, without a
  shuffle;
* otherwise both sides are cut into tiles of bounded size. Every tile is one
  task's work: matrix products by the slab that emit only rows of the answer. Cells
  around a few pivots leave out tiles which the triangle inequality proves
  empty; when that would not pay, everything is one cell. A dense cell is cut
  into more tiles, so a hot group never meets in one task.

Scores are rounded to nine decimals before any comparison, so that equal
vectors tie exactly whatever the block shape of the product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_DECIMALS = 9
# The hash that picks the components of signature planes.
PLANE_STEPS = (7919, 104729, 48271)
PLANE_MODULUS = 2147483647
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 << 20
TILE_ROWS = 4096
# Parts a side is cut into at least if it has as many tiles, and the most rows of a part.
STRIPES = 8
STRIPE_ROWS = 16_384
# Pairs that are worth a task.
TASK_PAIRS = 1 << 20
SLAB_ROWS = 512
PIVOTS = 64
# A margin for rounding: pruning must never lose a pair at the threshold.
SLACK = 1e-6


@dataclass(frozen=True)
class Limits:
    """When to broadcast and how large a tile may get."""

    broadcast_rows: int = BROADCAST_ROWS
    broadcast_bytes: int = BROADCAST_BYTES
    tile_rows: int = TILE_ROWS
    pivots: int = PIVOTS


# ---------------------------------------------------------------- matrices


def unit_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of a list column as float64 rows of length one (or zero)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows == 0:
        return np.zeros((0, 0))
    lengths = pc.list_value_length(column)
    if column.null_count or pc.count_distinct(lengths).as_py() > 1 or np.isnan(flat).any():
        raise ValueError("vectors must not be null and must have the same length and no missing parts")
    matrix = flat.reshape(rows, flat.size // rows)
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def reaches(raw: np.ndarray, threshold: float) -> np.ndarray:
    """Whether products round to the threshold or more."""
    return raw >= threshold - 0.5 * 10.0**-SCORE_DECIMALS


def _values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return np.asarray(column)
    return np.array(column.to_pylist(), dtype=object)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


# ----------------------------------------------------------------- kernels
#
# A kernel sees two sides as (ids, orders, unit matrix) and yields columns of
# its answer, one slab of rows at a time. It is started anew in every task.


def _pairs_kernel(threshold: float, ordered: bool):
    def kernel(left, right):
        (lid, lord, lmat), (rid, rord, rmat) = left, right
        for at in range(0, len(lid), SLAB_ROWS):
            raw = lmat[at : at + SLAB_ROWS] @ rmat.T
            i, j = np.nonzero(reaches(raw, threshold))
            if ordered:
                before = lord[at + i] < rord[j]
                i, j = i[before], j[before]
            if len(i):
                yield lid[at + i], rid[j], np.round(raw[i, j], SCORE_DECIMALS)

    return lambda left_is_held: kernel


def _exists_kernel(threshold: float):
    """Right ids that have a left partner of smaller order."""

    def kernel(left, right):
        (lid, lord, lmat), (rid, rord, rmat) = left, right
        found = np.zeros(len(rid), dtype=bool)
        for at in range(0, len(lid), SLAB_ROWS):
            open_ = np.flatnonzero(~found)
            if not len(open_):
                break
            hit = reaches(lmat[at : at + SLAB_ROWS] @ rmat[open_].T, threshold)
            hit &= lord[at : at + SLAB_ROWS, None] < rord[None, open_]
            found[open_] = hit.any(axis=0)
        if found.any():
            yield (rid[found],)

    return lambda left_is_held: kernel


def _earliest_kernel(threshold: float, compared=None):
    """Right ids with the smallest order of a left partner before them."""

    def kernel(left, right):
        (lid, lord, lmat), (rid, rord, rmat) = left, right
        if compared is not None:
            compared.add(len(lid) * len(rid))
        found = np.zeros(len(rid), dtype=bool)
        order = np.argsort(lord, kind="stable")
        for at in range(0, len(lid), SLAB_ROWS):
            slab = order[at : at + SLAB_ROWS]
            open_ = np.flatnonzero(~found & (rord > lord[slab[0]]))
            if not len(open_):
                continue
            hit = reaches(lmat[slab] @ rmat[open_].T, threshold)
            hit &= lord[slab, None] < rord[None, open_]
            some = hit.any(axis=0)
            found[open_[some]] = True
            if some.any():
                yield rid[open_[some]], lord[slab[hit[:, some].argmax(axis=0)]]

    return lambda left_is_held: kernel


def _best_kernel(k: int, threshold: float | None, earlier: bool):
    """Top k right rows of every left row, ties by right id.

    A task that sees the right side in batches remembers the k best products
    so far of each left row, and hands on only rows that reach them. What is
    within a rounding of the k-th counts as a tie until it is rounded.
    """

    def start(left_is_held: bool):
        best: dict[int, np.ndarray] = {}

        def kernel(left, right):
            (lid, lord, lmat), (rid, rord, rmat) = left, right
            for at in range(0, len(lid), SLAB_ROWS):
                raw = lmat[at : at + SLAB_ROWS] @ rmat.T
                if earlier:
                    raw = np.where(rord[None, :] < lord[at : at + SLAB_ROWS, None], raw, -np.inf)
                top = _largest(raw, k)
                if left_is_held:
                    top = _largest(np.hstack([best[at], top]), k) if at in best else top
                    best[at] = top
                floor = np.full(len(raw), -2.0)
                if top.shape[1] == k:
                    floor = np.maximum(floor, top.min(axis=1) - 10.0**-SCORE_DECIMALS)
                if threshold is not None:
                    floor = np.maximum(floor, threshold - 0.5 * 10.0**-SCORE_DECIMALS)
                i, j = np.nonzero(raw >= floor[:, None])
                if len(i):
                    score = np.round(raw[i, j], SCORE_DECIMALS)
                    keep = _first_k(i, score, rid[j], k)
                    yield lid[at + i[keep]], rid[j[keep]], score[keep]

        return kernel

    return start


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k largest of every row, in any order."""
    if values.shape[1] <= k:
        return values
    if k == 1:
        return values.max(axis=1, keepdims=True)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k:]


def _first_k(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of every group (groups are adjacent)."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    if (ends - starts <= k).all():
        return np.arange(len(group))
    kept = []
    for a, b in zip(starts, ends):
        rows = range(a, b)
        kept.extend(rows if b - a <= k else heapq.nsmallest(k, rows, key=lambda n: (-score[n], ids[n])))
    return np.array(kept)


# ------------------------------------------------------------ the two ways


def _side(df: DataFrame, id_: str, vec: str, order: str | None) -> DataFrame:
    key = F.col(order) if order else F.lit(0).cast("long")
    return df.select(F.col(id_).alias("id"), key.alias("ord"), F.col(vec).alias("vec"))


def _parts(table, id_: str = "id") -> tuple:
    return _values(table.column(id_)), _values(table.column("ord")), unit_matrix(table.column("vec"))


def _small(side: DataFrame, limits: Limits):
    """The side as arrays if it is proven small, else ``None``.

    Rows and bytes are measured in tasks; only a side within both limits reaches the driver.
    """
    if limits.broadcast_rows <= 0:
        return None
    width = F.coalesce(F.size("vec"), F.lit(0)) * F.lit(8) + F.lit(64)
    rows, size = side.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows > limits.broadcast_rows or size > limits.broadcast_bytes:
        return None
    table = side.toArrow()
    if table.num_rows > limits.broadcast_rows or table.nbytes > limits.broadcast_bytes:
        return None
    return _parts(table) if table.num_rows else ([], np.zeros(0, np.int64), None)


def _scan(big: DataFrame, small, small_is_left: bool, kernel, schema: T.StructType) -> DataFrame:
    shared = big.sparkSession.sparkContext.broadcast(small)
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        step = kernel(small_is_left)
        for batch in batches:
            if batch.num_rows == 0 or len(held[0]) == 0:
                continue
            here = _parts(batch)
            left, right = (held, here) if small_is_left else (here, held)
            for columns in step(left, right):
                yield _batch(arrow, *columns)

    return big.mapInArrow(run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.StringType(): pa.string(),
        T.DoubleType(): pa.float64(),
    }
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema.fields])


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in slabs, for steps that give a row many times over: a whole batch of copies would be held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLAB_ROWS):
            yield batch.slice(at, SLAB_ROWS)


def _assign(side: DataFrame, pivots: np.ndarray, radius: float | None) -> DataFrame:
    """Home cell of every row or, given a radius, every cell it can reach.

    A row y can have a partner in the cell of pivot p only if it lies within
    the radius of the hyperplane between p and its own nearest pivot.
    """
    gaps = np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0))
    schema = T.StructType([T.StructField("cell", T.IntegerType()), *side.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slabs(batches):
            unit = unit_matrix(batch.column("vec"))
            square = 1.0 + (unit * unit).sum(axis=1, keepdims=True) - 2.0 * (unit @ pivots.T)
            home = square.argmin(axis=1)
            if radius is None:
                rows, cells = np.arange(len(home)), home
            else:
                nearest = square[np.arange(len(home)), home][:, None]
                apart = gaps[home]
                beyond = np.where(
                    apart > 0, (square - nearest) / np.maximum(2.0 * apart, 1e-12), 0.0
                )
                rows, cells = np.nonzero(beyond <= radius + SLACK)
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int32)), *picked.columns], names=["cell", *batch.schema.names]
            )

    return side.mapInArrow(run, schema)


def _cell_counts(side: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["count"] for r in side.groupBy("cell").count().collect()}


def _in_cells(left: DataFrame, right: DataFrame, threshold: float | None, limits: Limits):
    """Both sides with a ``cell`` column, and the rows per cell of each."""
    whole_left = left.withColumn("cell", F.lit(0))
    whole_right = right.withColumn("cell", F.lit(0))
    if threshold is not None and limits.pivots > 1:
        # A bounded number of pivots, fixed by the ids and not by the partitioning.
        head = left.orderBy(F.xxhash64("id"), "id").limit(limits.pivots).toArrow()
        if head.num_rows > 1:
            pivots = np.unique(unit_matrix(head.column("vec")), axis=0)
            pivots = pivots[(pivots * pivots).sum(axis=1) > 0.5]
            if len(pivots) > 1:
                radius = float(np.sqrt(max(2.0 - 2.0 * threshold, 0.0)))
                home, reach = _assign(left, pivots, None), _assign(right, pivots, radius)
                at_home, reached = _cell_counts(home), _cell_counts(reach)
                total = sum(at_home.values()) * right.count()
                work = sum(n * reached.get(c, 0) for c, n in at_home.items())
                if work < 0.5 * total:
                    return home, reach, at_home, reached
    return whole_left, whole_right, _cell_counts(whole_left), _cell_counts(whole_right)


def _stripes(rows: int, cells: int, limits: Limits) -> int:
    """Parts a side of a cell is cut into: enough to occupy a cluster, and of bounded size.

    Each row is sent to every part of the other side, so there are no more of them than that, however small a tile is.
    """
    parts = max(-(-STRIPES // isqrt(cells)), -(-rows // STRIPE_ROWS))
    return min(parts, -(-rows // limits.tile_rows))


def _tiled(left: DataFrame, right: DataFrame, left_counts, right_counts, kernel, schema, limits: Limits) -> DataFrame:
    """Run the kernel over every tile; ``cell`` may be any integer key.

    A task holds the left rows of a tile and goes through the right ones by the slab,
    handing on what it finds, so neither a tile's pairs nor its answer are held as a whole.
    """
    cells = sorted(set(left_counts) & set(right_counts))
    if not cells:
        return left.sparkSession.createDataFrame([], schema)
    kind = left.schema["cell"].dataType.simpleString()
    rows, tiles = [], 0
    for c in cells:
        l, r = (_stripes(n[c], len(cells), limits) for n in (left_counts, right_counts))
        rows.append((c, l, r, tiles))
        tiles += l * r
    # One row per cell, and there are no more cells than pivots.
    blocks = F.broadcast(left.sparkSession.createDataFrame(rows, f"cell {kind}, _l int, _r int, _first long"))

    def cut(side, own, other, tile, is_right):
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias("_mine")
        met = side.join(blocks, "cell").select("id", "ord", "vec", "_r", "_first", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_other"))
        ids = [F.lit(None).alias("left_id"), F.col("id").alias("right_id")] if is_right else [F.col("id").alias("left_id"), F.lit(None).alias("right_id")]
        return met.select((F.col("_first") + tile).alias("tile"), F.lit(is_right).alias("is_right"), *ids, "ord", "vec")

    lefts = cut(left, "_l", "_r", F.col("_mine") * F.col("_r") + F.col("_other"), False)
    rights = cut(right, "_r", "_l", F.col("_other") * F.col("_r") + F.col("_mine"), True)
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, lot, step = None, [], None, None
        for batch in batches:
            tiles, sides = batch["tile"].to_numpy(), batch["is_right"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]) | (sides[1:] != sides[:-1])]) if len(tiles) else []
            for at, end in zip(starts, [*starts[1:], len(tiles)]):
                if tiles[at] != tile:
                    tile, held, lot = tiles[at], [], None
                if not sides[at]:
                    held.append(batch.slice(at, end - at))
                elif held:
                    if lot is None:
                        lot, step = _parts(pa.Table.from_batches(held), "left_id"), kernel(True)
                    for first in range(at, end, SLAB_ROWS):
                        slab = batch.slice(first, min(SLAB_ROWS, end - first))
                        for columns in step(lot, _parts(slab, "right_id")):
                            yield _batch(arrow, *columns)

    pairs = sum(left_counts[c] * right_counts[c] for c in cells)
    tasks = min(2 * tiles, 16 * left.sparkSession.sparkContext.defaultParallelism, 1 + pairs // TASK_PAIRS)
    met = lefts.unionByName(rights).repartition(tasks, "tile").sortWithinPartitions("tile", "is_right")
    return met.mapInArrow(run, schema)


def _meet(left: DataFrame, right: DataFrame, run, schema: T.StructType) -> DataFrame:
    """Cogroup by tile; fresh column identities allow both sides to be one table."""
    keys = ["cell", "lb", "rb"]
    other = right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(run, schema)


def _run(left, right, threshold, kernel, schema, limits: Limits, try_left=True, try_right=True) -> DataFrame:
    if try_left:
        small = _small(left, limits)
        if small is not None:
            return _scan(right, small, True, kernel, schema)
    if try_right:
        small = _small(right, limits)
        if small is not None:
            return _scan(left, small, False, kernel, schema)
    l, r, lc, rc = _in_cells(left, right, threshold, limits)
    return _tiled(l, r, lc, rc, kernel, schema, limits)


# --------------------------------------------------------------- operators


def similarity_join(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    left_id: str = "query_id",
    right_id: str = "chunk_id",
    vec: str = "embedding",
    limits: Limits = Limits(),
) -> DataFrame:
    """All pairs with cosine >= threshold: ``left_id, right_id, score``."""
    l, r = _side(left, left_id, vec, None), _side(right, right_id, vec, None)
    schema = T.StructType(
        [
            T.StructField(left_id, l.schema["id"].dataType),
            T.StructField(right_id, r.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return _run(l, r, threshold, _pairs_kernel(threshold, False), schema, limits)


def similar_pairs(
    df: DataFrame, threshold: float, id_: str = "vec_id", vec: str = "embedding", limits: Limits = Limits()
) -> DataFrame:
    """Unordered pairs of one table with cosine >= threshold, smaller id first."""
    side = _side(df, id_, vec, id_)
    kind = side.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id_a", kind), T.StructField("id_b", kind), T.StructField("score", T.DoubleType())]
    )
    return _run(side, side, threshold, _pairs_kernel(threshold, True), schema, limits, try_right=False)


def topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    threshold: float | None = None,
    query_id: str = "query_id",
    corpus_id: str = "chunk_id",
    vec: str = "embedding",
    limits: Limits = Limits(),
) -> DataFrame:
    """The k most similar corpus rows per query, best first, ties by id.

    Each task hands on at most k rows per query and batch, so what is
    shuffled for the final rank does not grow with the corpus rows.
    """
    q, c = _side(queries, query_id, vec, None), _side(corpus, corpus_id, vec, None)
    schema = T.StructType(
        [
            T.StructField(query_id, q.schema["id"].dataType),
            T.StructField(corpus_id, c.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    hits = _run(q, c, threshold, _best_kernel(k, threshold, False), schema, limits)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), F.col(corpus_id)))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, threshold: float, **names) -> DataFrame:
    """The one best match at or above the threshold, if there is one."""
    return topk(queries, corpus, k=1, threshold=threshold, **names).drop("rank")


def having_earlier_match(
    left: DataFrame, right: DataFrame, threshold: float, limits: Limits = Limits()
) -> DataFrame:
    """Right ids (``ord`` columns) with a left match of smaller ``ord``.

    Emits ids and never pairs, so a dense cluster costs rows once per tile.
    """
    l, r = _side(left, "ord", "vec", "ord"), _side(right, "ord", "vec", "ord")
    schema = T.StructType([T.StructField("ord", T.LongType())])
    return _run(l, r, threshold, _exists_kernel(threshold), schema, limits).distinct()


def earliest_match(left: DataFrame, right: DataFrame, threshold: float, limits: Limits = Limits(), compared=None) -> DataFrame:
    """``ord, match_ord``: right rows with the first of the left rows before them that is similar.

    At most one row per right row and tile, so a dense cluster lists no pairs.
    """
    l, r = _side(left, "ord", "vec", "ord"), _side(right, "ord", "vec", "ord")
    schema = T.StructType([T.StructField("ord", T.LongType()), T.StructField("match_ord", T.LongType())])
    hits = _run(l, r, threshold, _earliest_kernel(threshold, compared), schema, limits)
    return hits.groupBy("ord").agg(F.min("match_ord").alias("match_ord"))


def best_earlier_match(
    left: DataFrame, right: DataFrame, threshold: float, limits: Limits = Limits()
) -> DataFrame:
    """For each left ``ord`` the most similar right row of smaller ``ord``."""
    l, r = _side(left, "ord", "vec", "ord"), _side(right, "ord", "vec", "ord")
    schema = T.StructType(
        [
            T.StructField("ord", T.LongType()),
            T.StructField("match_ord", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    hits = _run(
        l, r, threshold, _best_kernel(1, threshold, True), schema, limits, try_left=False
    )
    best = F.max_by(F.struct("match_ord", "score"), F.struct("score", (-F.col("match_ord")).alias("m")))
    return hits.groupBy("ord").agg(best.alias("b")).select("ord", "b.match_ord", "b.score")


# ------------------------------------------------------------- approximate


@dataclass(frozen=True)
class SignBands:
    """Hyperplane signatures, cut into bands.

    The planes have components +1 and -1 that a hash of their position picks,
    so that every task, and any other engine, has the same planes.
    ``for_recall`` picks the number of bands such that a pair exactly at the
    threshold is found with about the wanted probability.
    """

    bits: int
    bands: int
    seed: int = 42

    @staticmethod
    def for_recall(threshold: float, recall: float = 0.95, bits: int = 8, seed: int = 42) -> SignBands:
        agree = (1.0 - np.arccos(threshold) / np.pi) ** bits
        bands = int(np.ceil(np.log(1.0 - recall) / np.log(1.0 - agree)))
        return SignBands(bits, max(1, bands), seed)

    def planes(self, dim: int) -> np.ndarray:
        i = np.arange(dim, dtype=np.int64)[:, None]
        p = np.arange(self.bits * self.bands, dtype=np.int64)[None, :]
        x = (i * PLANE_STEPS[0] + p * PLANE_STEPS[1] + self.seed) % PLANE_MODULUS
        x = x * x % PLANE_MODULUS * PLANE_STEPS[2] % PLANE_MODULUS
        return (x // 65536 % 2 * 2 - 1).astype(np.float64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        signs = (unit @ self.planes(unit.shape[1])) > 0
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return (signs.reshape(len(unit), self.bands, self.bits) * weights).sum(axis=2)


def similar_pairs_banded(
    df: DataFrame,
    threshold: float,
    bands: SignBands | None = None,
    id_: str = "vec_id",
    vec: str = "embedding",
    limits: Limits = Limits(),
) -> DataFrame:
    """Approximate form of :func:`similar_pairs`: no wrong pair, some missed.

    Rows meet where one band of their signatures agrees. A crowded bucket is
    cut into tiles like any other cell. A pair is emitted in the first band
    that agrees only, which spares a later distinct.
    """
    plan = bands or SignBands.for_recall(threshold)
    side = _side(df, id_, vec, id_)
    width = 1 << plan.bits
    schema_in = T.StructType([T.StructField("cell", T.LongType()), *side.schema.fields])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slabs(batches):
            keys = plan.keys(unit_matrix(batch.column("vec"))) + np.arange(plan.bands) * width
            rows = np.repeat(np.arange(batch.num_rows), plan.bands)
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), *picked.columns], names=["cell", *batch.schema.names]
            )

    base = _pairs_kernel(threshold, True)

    kind = side.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id_a", kind), T.StructField("id_b", kind), T.StructField("score", T.DoubleType())]
    )
    arrow = _arrow_schema(schema)

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        batches = []
        if a.num_rows and b.num_rows:
            band = key[0].as_py() // width
            left, right = _parts(a), _parts(b)
            lkeys, rkeys = plan.keys(left[2]), plan.keys(right[2])
            numbered = lambda side: (np.arange(len(side[0])), side[1], side[2])
            for i, j, s in base(False)(numbered(left), numbered(right)):
                first = (lkeys[i] == rkeys[j]).argmax(axis=1) == band
                batches.append(_batch(arrow, left[0][i[first]], right[0][j[first]], s[first]))
        return pa.Table.from_batches(batches, schema=arrow)

    placed = side.mapInArrow(spread, schema_in)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(limits.tile_rows)).cast("int").alias("blocks"))
    # At most bands x 2^bits rows, a bound set by the parameters.
    sized = placed.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = sized.withColumn("rb", others).withColumnRenamed("own", "lb").drop("blocks")
    right = sized.withColumn("lb", others).withColumnRenamed("own", "rb").drop("blocks")
    return _meet(left, right, run, schema)
