"""Mixing documents to target weights of domains they belong to softly, with DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.once import compute_once
from corpusloom.llm import hashed
from corpusloom.llm.common import text_or_empty
from corpusloom.operators.sizing import broadcast_if_small
from corpusloom.session import cut_lineage

SMOOTHING = 0.1
# A text's evidence counts as that of so many tokens at most, so that memberships stay soft.
EVIDENCE = 64
PASSES = 40
CUT_EVERY = 8
TOLERANCE = 1e-4


def domain_table(labelled: DataFrame, domains: list[str], buckets: int = hashed.BUCKETS) -> DataFrame:
    """``bucket`` and per domain its tokens in the labelled texts, as ``n0, n1, ...``."""
    tokens = compute_once(labelled, ["domain"], _tokens=hashed.token_array(F.col("text")))
    exploded = tokens.select("domain", F.explode(hashed.buckets_of(F.col("_tokens"), 1, buckets)).alias("bucket"))
    counts = [F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    return exploded.groupBy("bucket").agg(*counts)


def memberships(
    docs: DataFrame, labels: DataFrame, domains: list[str], buckets: int = hashed.BUCKETS
) -> DataFrame:
    """``doc_id, n_tokens, p`` with the chance of each domain, from ``docs`` (``doc_id, text``) and
    ``labels`` (``doc_id, domain``, one row per id).

    A table of token weights per domain is counted from the labelled texts and
    looked up in place, so that a text stays in its row. Without labels all
    domains are as likely.
    """
    spark = docs.sparkSession
    labelled = docs.join(broadcast_if_small(labels), "doc_id")
    table = cut_lineage(domain_table(labelled, domains, buckets))
    totals = table.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(len(domains))]).first()
    found = dict(labels.groupBy("domain").count().collect())
    seen = [found.get(d, 0) + 1 for d in domains]

    tokens = compute_once(docs, ["doc_id"], _tokens=hashed.token_array(F.col("text")))
    rows = compute_once(tokens, ["doc_id"], _found=hashed.buckets_of(F.col("_tokens"), 1, buckets))
    n = F.size("_found")
    values, scores = {}, []
    for k, total in enumerate(totals):
        weight = F.log((F.coalesce(f"n{k}", F.lit(0)) + SMOOTHING) / (total + SMOOTHING * buckets))
        values[f"_sum{k}"] = hashed.dense(spark, table, weight, buckets)
        mean = F.col(f"_sum{k}") / n
        evidence = F.when(n > 0, mean * F.least(n, F.lit(EVIDENCE))).otherwise(0.0)
        scores.append(evidence + float(np.log(seen[k] / sum(seen))))
    rows = hashed.with_sums(rows, "_found", values)
    scored = compute_once(rows, ["doc_id"], n_tokens=n.cast("long"), _s=F.array(*scores))
    shifted = F.transform("_s", lambda s: F.exp(s - F.array_max("_s")))
    powers = compute_once(scored, ["doc_id", "n_tokens"], _e=shifted)
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return powers.select("doc_id", "n_tokens", F.transform("_e", lambda x: x / total).alias("p"))


def _lowered(rate: Column, c: np.ndarray, least: Column, most: float | None) -> Column:
    """One projected step: the rate less the document's share of each domain's correction, put back between its bounds."""
    step = F.lit(0.0)
    for k, v in enumerate(c.tolist()):
        step = step + F.col("p")[k] * v
    moved = F.greatest(least, rate - step)
    return moved if most is None else F.least(F.lit(float(most)), moved)


def document_rates(
    members: DataFrame,
    targets: list[float],
    start: float = 1.0,
    passes: int = PASSES,
    anchor: int | None = None,
    most: float | None = None,
) -> DataFrame:
    """Add ``rate``: non-negative document rates with which the expected tokens of each domain match ``targets``.

    Projected gradient descent on the squared misses of the domains' totals, from
    one rate for all. The misses are scaled by the inverse of the domains' joint
    token moments, so that the step length is one and small domains do not lag.
    A pass is one aggregate of a few sums over a narrow table; the rates are an
    expression over it, written out every few passes. Passes end when all totals
    are within 0.0001 of their targets, relative to all tokens.

    ``most`` bounds the rates from above, inside the descent. With an ``anchor``, the number of a
    domain, documents that belong to it by half or more keep the full rate, and
    the targets of the others follow its total in the proportion of ``targets``. What
    cannot be met under the bounds stays missed: see :func:`shares`.
    """
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    t = F.col("n_tokens")
    moments = members.agg(F.coalesce(F.sum(t), F.lit(0)), *[F.coalesce(F.sum(t * a * b), F.lit(0.0)) for a in p for b in p]).first()
    mass = float(moments[0])
    start = start if most is None else min(start, float(most))
    if not mass:
        return members.withColumn("rate", F.lit(start))
    joint = np.array([float(v) for v in moments[1:]]).reshape(k, k) / mass
    inverse = np.linalg.inv(joint + 1e-6 * np.eye(k))
    goal = np.array(targets) / mass
    least = F.lit(0.0) if anchor is None else F.when(p[anchor] >= 0.5, F.lit(start)).otherwise(F.lit(0.0))

    state = members.withColumn("rate", F.lit(start))
    rate: Column = F.col("rate")
    for turn in range(passes):
        totals = np.array([float(v) for v in state.agg(*[F.sum(t * rate * a) for a in p]).first()]) / mass
        miss = totals - (goal if anchor is None else goal * (totals[anchor] / goal[anchor]))
        if np.abs(miss).max() < TOLERANCE:
            break
        rate = _lowered(rate, inverse @ miss, least, most)
        if turn % CUT_EVERY == CUT_EVERY - 1:
            state = cut_lineage(state.withColumn("rate", rate))
            rate = F.col("rate")
    return state.withColumn("rate", rate)


def shares(found: DataFrame, weights: dict[str, float], by: str = "copies") -> DataFrame:
    """``domain, wanted, share``: the part of the expected tokens that each domain has, by ``copies`` or ``rate``, of the rows of :func:`mixed`."""
    domains = sorted(weights)
    tokens = [F.sum(F.col("n_tokens") * F.col(by) * F.col("p")[k]).alias(f"t{k}") for k in range(len(domains))]
    total = F.sum(F.col("n_tokens") * F.col(by)).alias("total")
    rows = [
        F.struct(F.lit(d).alias("domain"), F.lit(weights[d] / sum(weights.values())).alias("wanted"), (F.col(f"t{k}") / F.col("total")).alias("share"))
        for k, d in enumerate(domains)
    ]
    return found.agg(*tokens, total).select(F.inline(F.array(*rows)))


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    anchor: str | None = None,
    most_copies: int | None = None,
    seed: int = 29,
    buckets: int = hashed.BUCKETS,
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, p``, its ``rate`` and the whole number of ``copies`` to take.

    ``labels`` gives ``doc_id, domain`` for some documents; ``weights`` the wanted
    share of the tokens per domain. The targets sum to all tokens, or, with an
    ``anchor``, follow what that domain has: its documents stay whole. ``most_copies``
    bounds the rates. A rate's fraction becomes a copy by a hash of the id, the same
    in every run. Domains of other names are not learned from.

    Null texts count as empty and have the rate of an average text. Repeated rows
    are treated alike; an id with several domains has the first in order of name.
    An empty table gives no rows, and without any label every rate is one.
    """
    domains = sorted(weights)
    share = np.array([weights[d] for d in domains], float) / sum(weights.values())
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    known = cut_lineage(known.groupBy("doc_id").agg(F.min("domain").alias("domain")))
    members = cut_lineage(memberships(rows, known, domains, buckets))
    own = members.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("p")[i]), F.lit(0.0)) for i in range(len(domains))]).first()
    held = domains.index(anchor) if anchor is not None and own[domains.index(anchor)] else None
    if known.isEmpty():
        rated = members.withColumn("rate", F.lit(1.0))
    else:
        total = float(sum(own)) if held is None else float(own[held]) / share[held]
        rated = document_rates(members, (share * total).tolist(), anchor=held, most=most_copies)
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return rated.withColumn("copies", copies)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The documents, each as often as its copies say, with all their columns; rows without an id are taken once.

    Rows that repeat an id are taken as often as the one with the most copies.
    """
    found = mixed(docs, labels, weights, id_col, text_col, **more).where("doc_id is not null")
    copies = found.groupBy("doc_id").agg(F.max("copies").alias("copies"))
    changed = cut_lineage(copies.where("copies <> 1"))
    # Whole rows travel as one column, so that no name of theirs meets another.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id")).join(broadcast_if_small(changed), "doc_id", "left")
    times = F.array_repeat(F.lit(0), F.coalesce("copies", F.lit(1)).cast("int"))
    return rows.select("row", F.explode(times)).select("row.*")
