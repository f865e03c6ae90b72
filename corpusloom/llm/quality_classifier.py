"""Quality scores by positive-unlabelled learning over text statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import text_or_empty, text_slices
from corpusloom.operators.sizing import broadcast_if_small
from corpusloom.session import cut_lineage

FEATURES = [
    "log_words", "mean_length", "spread_length", "short_words", "long_words", "letters", "capitals", "digits", "symbols",
    "bars", "shouts", "stops", "wordless", "all_capitals", "repeats_next", "top_word", "distinct", "distinct_triples",
    "repeated_lines", "closed_lines", "words_a_line", "no_words",
]
SYMBOLS = "#$%&*<>=@^~_\\{}[]"
PASSES = 30
RIDGE = 1e-3

_digit = re.compile(r"\d")


def text_features(text: str) -> list[float]:
    """Statistics of a whole text, most of them shares between 0 and 1; a text without words has zeros and ``no_words``."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    spread = math.sqrt(max(0.0, sum(x * x for x in lengths) / n - mean * mean))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = math.sqrt
    letters = sum(map(text.count, "aeiou")) / chars
    triples = len(set(zip(words, words[1:], words[2:])))
    return [
        math.log1p(n),
        mean / 10,
        spread / 10,
        sum(x <= 3 for x in lengths) / n,
        sum(x >= 10 for x in lengths) / n,
        letters,
        share(sum(map(str.isupper, text)) / chars),
        share(len(_digit.findall(text)) / chars),
        share(sum(map(text.count, SYMBOLS)) / chars),
        share(text.count("|") / chars),
        share(text.count("!") / chars),
        share(text.count(".") / chars),
        share(sum(not w.isalnum() and not any(map(str.isalpha, w)) for w in words) / n),
        share(sum(map(str.isupper, words)) / n),
        share(sum(map(str.__eq__, words, words[1:])) / n),
        max(counts.values()) / n,
        len(counts) / n,
        triples / max(1, n - 2),
        share(1 - len(set(lines)) / len(lines)),
        sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / len(lines),
        math.log1p(n / len(lines)) / 5,
        0.0,
    ]


def featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, x`` with one number per feature."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType(), False))]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = pa.array([text_features(t) for t in batch["text"].to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], x], names=schema.names)

    return rows.mapInArrow(measure, schema)


def risk_sums(rows: DataFrame, weights: np.ndarray) -> dict[str, np.ndarray]:
    """What one pass over ``x, positive`` gives: counts, risks, their gradients, and the curvature of the unlabelled risk.

    A task hands on one row of sums, whose size depends on the number of features alone.
    """
    d = len(weights)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5 + 3 * d + d * d)
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1)
            x = np.c_[x, np.ones(len(x))]
            p = batch["positive"].to_numpy(zero_copy_only=False).astype(bool)
            z = x @ weights
            rise = np.exp(-np.logaddexp(0, -z))  # the slope of the loss as a negative
            as_negative = np.logaddexp(0, z)
            total[:2] += p.sum(), len(p)
            total[2:5] += (as_negative - z)[p].sum(), as_negative[p].sum(), as_negative.sum()
            total[5 : 5 + 3 * d] += np.r_[(rise[p] - 1) @ x[p], rise[p] @ x[p], rise @ x]
            total[5 + 3 * d :] += ((x * (rise * (1 - rise))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    found = rows.select("x", "positive").mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v")).collect()
    total = np.zeros(5 + 3 * d + d * d)
    for k, v in found:
        total[k] = v
    n_p, n_u = max(total[0], 1.0), max(total[1], 1.0)
    g = total[5 : 5 + 3 * d].reshape(3, d)
    return {
        "positives": total[0], "rows": total[1],
        "p_plus": total[2] / n_p, "p_minus": total[3] / n_p, "u_minus": total[4] / n_u,
        "g_p_plus": g[0] / n_p, "g_p_minus": g[1] / n_p, "g_u_minus": g[2] / n_u,
        "h_u": total[5 + 3 * d :].reshape(d, d) / n_u,
    }


def fit(rows: DataFrame, prior: float, width: int, passes: int = PASSES, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic model, the last one constant, by the non-negative risk estimate over all rows.

    The risk of positives as positives weighs ``prior``. That of the negatives
    is what the unlabelled rows cost as negatives less ``prior`` times what the
    positives do, and must not fall below zero: where it would, the model has
    begun to fit single rows, and a step is taken that raises it again.
    """
    w = np.zeros(width + 1)
    step = 1.0
    for _ in range(passes):
        s = risk_sums(rows, w)
        if not s["positives"] or not s["rows"]:
            w[-1] = math.log(prior / (1 - prior))
            return w
        negative = s["u_minus"] - prior * s["p_minus"]
        keep = ridge * np.r_[np.ones(width), 0.0]
        if negative < 0:
            w = w - step * (prior * s["g_p_minus"] - s["g_u_minus"])
            step /= 2
            continue
        gradient = prior * s["g_p_plus"] + s["g_u_minus"] - prior * s["g_p_minus"] + keep * w
        curvature = s["h_u"] + np.diag(keep + 1e-9)
        move = np.linalg.solve(curvature, gradient)
        longest = np.abs(move).max()
        w = w - step * move * min(1.0, 4.0 / max(longest, 1e-12))
        if longest < 1e-4:
            break
    return w


def id_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row per labelled id; an id with several labels has the larger one."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    prior: float | None = None,
) -> DataFrame:
    """``doc_id, score`` for every document; the score is the chance of label 1.

    Trusted positives are the rows labelled 1, and the unlabelled web text is
    that of all documents, both where ``may_learn`` (over ``doc_id``) holds.
    ``prior`` is the share of good documents; if it isn't given, it is estimated
    as the share of label 1 among the labels that may be learned from.

    Features are scaled by their mean and spread over the rows learned from.
    Null texts count as empty. Without any positives every score is the prior,
    0.5 if that isn't known either. Repeated rows are scored alike.
    """
    known = id_labels(labels, id_col, label_col).where(may_learn)
    table = cut_lineage(featured(docs, id_col, text_col))
    if prior is None:
        prior = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
        prior = min(0.95, max(0.05, 0.5 if prior is None else prior))
    positive = cut_lineage(known.where("label = 1").select("doc_id", F.lit(True).alias("positive")))
    rows = table.where(may_learn).join(broadcast_if_small(positive), "doc_id", "left")
    rows = cut_lineage(rows.select("x", F.coalesce("positive", F.lit(False)).alias("positive")))

    d = len(FEATURES)
    x = [F.col("x")[i] for i in range(d)]
    stats = rows.agg(*[f(v) for v in x for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([stats[2 * i] or 0.0 for i in range(d)])
    scale = np.array([1 / s if (s := stats[2 * i + 1]) and s > 1e-6 else 0.0 for i in range(d)])
    scaled = cut_lineage(rows.select(F.array(*[(v - m) * s for v, m, s in zip(x, mean.tolist(), scale.tolist())]).alias("x"), "positive"))
    w = fit(scaled, prior, d)
    z = F.lit(float(w[-1] - (w[:-1] * mean * scale).sum()))
    for v, a in zip(x, (w[:-1] * scale).tolist()):
        z = z + v * a
    return table.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def keep_good(
    docs: DataFrame, labels: DataFrame, may_learn: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; rows without an id stay."""
    scores = quality_scores(docs, labels, may_learn, id_col, text_col)
    # Rows that repeat an id stay or go together, by their best score.
    best = scores.where("doc_id is not null").groupBy("doc_id").agg(F.max("score").alias("score"))
    drop = cut_lineage(best.where(F.col("score") < threshold).select(F.col("doc_id").alias(id_col)))
    return docs.join(broadcast_if_small(drop), id_col, "left_anti").select(*docs.columns)
