"""Entity resolution in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import similarity as sim
from corpusloom.operators.links import linked_leaders
from corpusloom.operators.similarity import SLAB_ROWS, reaches, unit_matrix
from corpusloom.operators.sizing import join_unique
from corpusloom.session import cut_lineage

RESOLVE_THRESHOLD = 0.92
FINISH_ROWS = 8192


def _in_order(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Flag the leaders among a bounded number of rows, one after the other."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by("ord").combine_chunks()
    unit = unit_matrix(table.column("vec"))
    leads = np.zeros(table.num_rows, dtype=bool)
    follows = np.zeros(table.num_rows, dtype=bool)
    for at in range(0, table.num_rows, SLAB_ROWS):
        near = reaches(unit[at : at + SLAB_ROWS] @ unit.T, threshold)
        for i in range(len(near)):
            if not follows[at + i]:
                leads[at + i] = True
                follows |= near[i]
    yield from table.append_column("leads", pa.array(leads)).to_batches()


def leaders(
    vectors: DataFrame,
    threshold: float = RESOLVE_THRESHOLD,
    finish_rows: int = FINISH_ROWS,
    limits: sim.Limits = sim.Limits(),
    compared: Accumulator | None = None,
) -> DataFrame:
    """Rows (``ord, vec``) that no earlier leader is similar to.

    Few rows are settled in one bounded task, in order. Of many, the first
    ``finish_rows`` are, and what follows their leaders is dropped: large similar
    groups are gone after comparing each row with a bounded number of leaders.
    The rest is settled by links (:mod:`corpusloom.operators.links`).
    """
    # Equal vectors collapse on the map side; only the first can lead. A vector without a direction is
    # similar to none, not even to its like, and leads itself.
    alone = F.when(~F.exists("vec", lambda x: x != 0), F.col("ord"))
    open_ = cut_lineage(vectors.groupBy("vec", alone.alias("_alone")).agg(F.min("ord").alias("ord")).select("ord", "vec"))
    flagged = T.StructType([*open_.schema.fields, T.StructField("leads", T.BooleanType())])
    head = open_.orderBy("ord").limit(finish_rows).coalesce(1)
    settled = cut_lineage(head.mapInArrow(lambda batches: _in_order(batches, threshold), flagged))
    first = settled.where("leads").select("ord", "vec")
    if open_.count() <= finish_rows:
        return first
    reached = settled.agg(F.max("ord")).first()[0]
    rest = cut_lineage(_without_followers(first, open_.where(F.col("ord") > reached), threshold, limits))
    return first.unionByName(linked_leaders(rest, threshold, limits, compared=compared))


def _without_followers(lead: DataFrame, rows: DataFrame, threshold: float, limits: sim.Limits) -> DataFrame:
    return rows.join(sim.having_earlier_match(lead, rows, threshold, limits), "ord", "left_anti")


def resolve_entities(
    entities: DataFrame,
    threshold: float = RESOLVE_THRESHOLD,
    order: str = "ord",
    vec: str = "embedding",
    stored: DataFrame | None = None,
    finish_rows: int = FINISH_ROWS,
    limits: sim.Limits = sim.Limits(),
    compared: Accumulator | None = None,
) -> DataFrame:
    """``order, leader_order, score`` for every entity.

    A leader points at itself with score 1; any other row points at the most
    similar leader that arrived before it. ``order`` must be unique, and
    ``entities`` a stored table, as it is read more than once.

    ``stored`` holds the leaders of earlier runs, with smaller orders: the
    rows are then resolved as if they had arrived right after them. ``compared``
    counts the pairs that the links took.
    """
    rows = _ordered(entities, order, vec)
    open_ = rows
    if stored is not None:
        old = _ordered(stored, order, vec)
        open_ = cut_lineage(_without_followers(old, rows, threshold, limits))
    led = leaders(open_, threshold, finish_rows, limits, compared)
    others = rows.join(led.select("ord"), "ord", "left_anti")
    everyone = led if stored is None else old.unionByName(led)
    matched = sim.best_earlier_match(others, everyone, threshold, limits)
    return (
        led.select("ord", F.col("ord").alias("match_ord"), F.lit(1.0).alias("score"))
        .unionByName(matched)
        .select(F.col("ord").alias(order), F.col("match_ord").alias(f"leader_{order}"), "score")
    )


def resolve_mentions(
    mentions: DataFrame,
    vectors: DataFrame,
    threshold: float = RESOLVE_THRESHOLD,
    vec: str = "embedding",
    stored: DataFrame | None = None,
    finish_rows: int = FINISH_ROWS,
    limits: sim.Limits = sim.Limits(),
) -> DataFrame:
    """``ord, leader_ord, score`` for every mention, as :func:`resolve_entities` gives it, with each text compared once.

    ``mentions`` are ``ord, text_ord`` where ``text_ord`` is the first mention of the same
    text, ``vectors`` hold ``text_ord`` and its vector; both are stored tables. A later
    mention follows the most similar leader that arrived before it, which may be
    another than its text's first mention had. Mentions whose text has a vector
    without a direction each lead themselves.
    """
    rows = _ordered(vectors, "text_ord", vec)
    none = ~F.exists("vec", lambda x: x != 0)
    open_ = rows.where(~none)
    old = None if stored is None else _ordered(stored, "ord", vec)
    if old is not None:
        open_ = cut_lineage(_without_followers(old, open_, threshold, limits))
    led = cut_lineage(leaders(open_, threshold, finish_rows, limits))
    everyone = led if old is None else cut_lineage(old.unionByName(led))
    # A text is similar to few leaders, as they are not similar to each other.
    pairs = sim.similarity_join(
        rows.withColumnRenamed("ord", "text_ord"), everyone.withColumnRenamed("ord", "leader_ord"), threshold,
        "text_ord", "leader_ord", "vec", limits,
    )
    own = F.struct(F.col("leader_ord"), F.col("score"))
    near = cut_lineage(pairs.groupBy("text_ord").agg(F.collect_list(own).alias("near")))
    matched = join_unique(mentions, near, "text_ord", ["ord"], limit=0)
    order = lambda m: F.struct((-(m["leader_ord"] == F.col("ord")).cast("int")).alias("own"), (-m["score"]).alias("far"), m["leader_ord"].alias("leader_ord"))
    before = F.filter("near", lambda m: m["leader_ord"] <= F.col("ord"))
    best = F.array_min(F.transform(before, order))
    found = matched.select("ord", best.alias("best")).select(
        "ord", "best.leader_ord", F.when(F.col("ord") == F.col("best.leader_ord"), F.lit(1.0)).otherwise(-F.col("best.far")).alias("score")
    )
    alone = join_unique(mentions, rows.where(none).select(F.col("ord").alias("text_ord")), "text_ord", ["ord"])
    return found.unionByName(alone.select("ord", F.col("ord").alias("leader_ord"), F.lit(1.0).alias("score")))


def _ordered(df: DataFrame, order: str, vec: str) -> DataFrame:
    return df.select(F.col(order).cast("long").alias("ord"), F.col(vec).alias("vec"))
