"""Positive-unlabelled learning: the risk, its minimum, and held-out labels."""

import numpy as np
import pytest

from corpusloom.llm import quality_classifier as qc
from corpusloom.llm import queries
from pyspark.sql import functions as F


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    good = np.array(labels) == 1
    n1, n0 = good.sum(), (~good).sum()
    return (order[good].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_op9_tells_held_out_labels_apart(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op9_quality_classifier(spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 1]) > 0.98


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    learn = F.col("doc_id") % 3 != 0
    a = {r.doc_id: r.score for r in qc.quality_scores(docs, labels, learn).collect()}
    turned = labels.withColumn("quality", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    b = {r.doc_id: r.score for r in qc.quality_scores(docs.withColumn("lang", F.lit("x")), turned, learn).collect()}
    assert a == pytest.approx(b)


def test_sums_and_minimum_equal_plain_numpy(spark):
    rng = np.random.default_rng(3)
    good = rng.random(600) < 0.7
    x = np.c_[rng.normal(np.where(good, 1.0, -1.0), 1.0), rng.normal(size=600)]
    p = good & (rng.random(600) < 0.4)
    rows = spark.createDataFrame([(v.tolist(), bool(k)) for v, k in zip(x, p)], "x array<double>, positive boolean").repartition(3)
    w = np.array([0.3, -0.2, 0.1])
    one = np.c_[x, np.ones(600)]
    z = one @ w
    s = qc.risk_sums(rows, w)
    slope = 1 / (1 + np.exp(-z))
    assert s["positives"] == p.sum() and s["rows"] == 600
    assert s["u_minus"] == pytest.approx(np.log1p(np.exp(z)).mean())
    assert s["p_plus"] == pytest.approx(np.log1p(np.exp(-z))[p].mean())
    assert s["g_u_minus"] == pytest.approx((one * slope[:, None]).mean(0))
    assert s["h_u"] == pytest.approx((one * (slope * (1 - slope))[:, None]).T @ one / 600)
    found = qc.fit(rows, 0.7, 2)

    def risk(w):
        z = one @ w
        negative = np.logaddexp(0, z).mean() - 0.7 * np.logaddexp(0, z)[p].mean()
        return 0.7 * np.logaddexp(0, -z)[p].mean() + max(0, negative) + qc.RIDGE / 2 * (w[:-1] ** 2).sum()

    least = risk(found)
    assert all(risk(found + rng.normal(scale=0.05, size=3)) >= least - 1e-6 for _ in range(200))


def test_dirty_rows(spark, dirty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = qc.quality_scores(dirty, labels, F.lit(True)).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    none = qc.quality_scores(dirty, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    kept = qc.keep_good(dirty, labels, F.lit(True))
    assert kept.columns == dirty.columns and kept.where("doc_id is null").count() == 1
    assert qc.quality_scores(dirty.limit(0), labels, F.lit(True)).count() == 0
