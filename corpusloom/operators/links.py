"""Leaders in arrival order, from a sparse graph of links and a proof that it misses none that matters.

The rule is sequential: a row leads unless it is similar to a leader that arrived
before it. All pairs of similar rows would settle it, and so do far fewer: any
set of true links whose leaders are not similar to each other gives the same
leaders, since each row outside follows an earlier leader and each leader has
none before it. So links are first looked for where signatures agree, and then
only the leaders they leave are compared with each other, with cells around
pivots to prove most of them apart. A link found there is added, and the few
leaders that change are compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from math import acos, isqrt, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import similarity as sim
from corpusloom.operators.similarity import SLAB_ROWS, reaches, unit_matrix
from corpusloom.session import cut_lineage

# Rows of a bucket that meet in one task; larger buckets are dealt out.
BUCKET_ROWS = 4096
# Rows that unrelated vectors share a bucket with, about.
BUCKET_GOAL = 64
BANDS = 2
# A band should keep a pair at the threshold together at least this often.
KEEP = 0.3
MOST_BITS = 20
MOST_PIVOTS = 2048
# Links that one task settles in order.
FINISH_LINKS = 1 << 20


def band_plan(rows: int, threshold: float, turn: int) -> sim.SignBands:
    """Signature bands for so many rows; other planes for each turn."""
    together = 1.0 - acos(max(-1.0, min(1.0, threshold))) / pi
    bits = min(MOST_BITS, log2(max(2, rows / BUCKET_GOAL)), log(KEEP) / log(min(together, 1 - 1e-9)))
    return sim.SignBands(max(1, int(bits)), BANDS, 42 + 1009 * turn)


def local_links(unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links from each row, in order, to the earlier leaders among the rows; and how many pairs were compared.

    Leaders are chosen as if there were no other rows. Rows are compared with
    leaders only, and those without one with each other by the slab.
    """
    leaders = np.zeros(0, np.int64)
    left, right, compared = [], [], 0
    for at in range(0, len(unit), SLAB_ROWS):
        slab = np.arange(at, min(len(unit), at + SLAB_ROWS))
        near = reaches(unit[slab] @ unit[leaders].T, threshold)
        compared += near.size
        row, leader = np.nonzero(near)
        left.append(leaders[leader])
        right.append(slab[row])
        open_ = slab[~near.any(1)]
        inside = reaches(unit[open_] @ unit[open_].T, threshold)
        compared += inside.size // 2
        leads = np.zeros(len(open_), bool)
        follows = np.zeros(len(open_), bool)
        for i in range(len(open_)):
            if not follows[i]:
                leads[i] = True
                follows |= inside[i]
        leader, row = np.nonzero(np.triu(inside, 1) & leads[:, None])
        left.append(open_[leader])
        right.append(open_[row])
        leaders = np.r_[leaders, open_[leads]]
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)]), compared


def banded_links(rows: DataFrame, threshold: float, plan: sim.SignBands, compared: Accumulator | None = None) -> DataFrame:
    """True links ``a, b`` (the earlier row first) between rows ``ord, vec`` that share a bucket.

    A bucket is dealt out to parts of bounded size, and a row is linked to the
    leaders of its part only, so a crowded bucket gives no more than rows times
    leaders. What this misses is found by other bands or by the proof.
    """
    width = 1 << plan.bits

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = plan.keys(unit_matrix(batch["vec"])) + np.arange(plan.bands) * width
                picked = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), plan.bands)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *picked.columns], names=["cell", *batch.schema.names])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        a, b, n = local_links(unit_matrix(table["vec"]), threshold)
        if compared is not None:
            compared.add(n)
        ord_ = table["ord"].to_numpy()
        return pa.table({"a": ord_[a], "b": ord_[b]})

    placed = rows.select("ord", "vec").mapInArrow(spread, f"cell long, ord long, vec {rows.schema['vec'].dataType.simpleString()}")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BUCKET_ROWS)).alias("parts"))
    # At most bands x 2^bits rows, a bound set by the parameters.
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("ord", F.lit(plan.seed)), F.col("parts")))
    return dealt.groupBy("cell", "part").applyInArrow(meet, "a long, b long").distinct()


def followers(links: DataFrame, finish_links: int = FINISH_LINKS) -> DataFrame:
    """``ord`` of the rows with an earlier linked row that leads; ``links`` are ``a, b`` with a before b.

    In a round the rows without an earlier open row lead and those linked to
    them follow, all at once; when few links are open, one task settles them in order.
    """

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).sort_by([("b", "ascending"), ("a", "ascending")])
            found: set[int] = set()
            for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist()):
                if a not in found:
                    found.add(b)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["ord"])

    open_ = cut_lineage(links.select("a", "b").distinct())
    found = None
    while (left := open_.count()) > finish_links:
        later = open_.select(F.col("b").alias("a")).distinct()
        lead = open_.select("a").distinct().join(later, "a", "left_anti")
        follow = cut_lineage(open_.join(lead, "a", "left_semi").select(F.col("b").alias("ord")).distinct())
        found = follow if found is None else found.unionByName(follow)
        rest = open_.join(follow.withColumnRenamed("ord", "a"), "a", "left_anti")
        open_ = cut_lineage(rest.join(follow.withColumnRenamed("ord", "b"), "b", "left_anti").select("a", "b"))
    last = open_.coalesce(1).mapInArrow(in_order, "ord long") if left else open_.select(F.col("a").alias("ord"))
    return cut_lineage(last if found is None else found.unionByName(last))


def linked_leaders(
    rows: DataFrame,
    threshold: float,
    limits: sim.Limits = sim.Limits(),
    finish_links: int = FINISH_LINKS,
    compared: Accumulator | None = None,
) -> DataFrame:
    """The rows ``ord, vec`` that lead; ``rows`` is a stored table with unique ``ord``.

    Bands are tried as long as each turn leaves a fifth fewer leaders to compare.
    """
    lead, size, links, turn = rows, rows.count(), None, 0
    while size:
        found = banded_links(lead, threshold, band_plan(size, threshold, turn), compared)
        links = cut_lineage(found if links is None else links.unionByName(found))
        lead = cut_lineage(rows.join(followers(links, finish_links), "ord", "left_anti"))
        before, size, turn = size, lead.count(), turn + 1
        if size > 0.8 * before:
            break
    fresh, proven = lead, None
    while size:
        # Leaders that were compared before are not compared again.
        more = replace(limits, pivots=max(limits.pivots, min(MOST_PIVOTS, isqrt(size)))) if limits.pivots > 1 else limits
        missed = sim.earliest_match(lead, fresh, threshold, more, compared)
        if proven is not None:
            missed = missed.unionByName(sim.earliest_match(fresh, proven, threshold, more, compared))
        missed = cut_lineage(missed.select(F.col("match_ord").alias("a"), F.col("ord").alias("b")))
        if missed.isEmpty():
            break
        links = cut_lineage(links.unionByName(missed))
        now = cut_lineage(rows.join(followers(links, finish_links), "ord", "left_anti"))
        # A row with a missed link may have more of them than the first, which is all that was asked for.
        apart = lead.select("ord").join(missed.select(F.col("b").alias("ord")), "ord", "left_anti")
        fresh = cut_lineage(now.join(apart, "ord", "left_anti"))
        proven = now.join(fresh.select("ord"), "ord", "left_anti")
        lead = now
        if fresh.isEmpty():
            break
    return lead
