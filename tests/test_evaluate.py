import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.operators import evaluate as ev

# The published test-split lift table (decile: total, churn).
LIFT_GOLDEN = [(141, 104), (141, 80), (140, 66), (141, 43), (140, 28), (141, 27), (141, 14),
               (140, 10), (141, 0), (141, 2)]
BASELINE = 0.2658137882018479
TOP_LIFT = 2.7748321765843666


def lift_frame(spark):
    rows, i = [], 0
    n = sum(t for t, _ in LIFT_GOLDEN)
    for total, churn in LIFT_GOLDEN:
        for j in range(total):
            rows.append((f"r{i:04d}", 1 if j < churn else 0, (n - i) / n))
            i += 1
    return spark.createDataFrame(rows, "id string, label int, score double")


def test_lift_golden(spark):
    out = ev.lift_deciles(lift_frame(spark)).orderBy("decil").collect()
    assert [(r.total, r.churn) for r in out] == LIFT_GOLDEN
    assert out[0].lift == pytest.approx(round(TOP_LIFT, 6))
    assert out[0].baseline == pytest.approx(round(BASELINE, 6))


def test_lift_strict_raises_on_duplicate_edges(spark):
    df = spark.createDataFrame([(1, 0.5)] * 50 + [(0, 0.1)] * 5, "label int, score double")
    with pytest.raises(Exception):
        ev.lift_deciles(df, strict=True).collect()
    assert ev.lift_deciles(df).count() >= 1


def matrix_frame(spark):
    rows = [(0, 0)] * 714 + [(0, 1)] * 319 + [(1, 0)] * 70 + [(1, 1)] * 304
    return spark.createDataFrame(rows, "label int, pred int")


def test_report_golden(spark):
    rep = {r["class"]: r for r in ev.classification_report(matrix_frame(spark)).collect()}
    assert round(rep["1"].precision, 4) == 0.4880 and round(rep["1"].recall, 4) == 0.8128
    assert round(rep["0"].precision, 4) == 0.9107 and round(rep["0"].recall, 4) == 0.6912
    assert round(rep["0"].f1, 4) == 0.7859 and round(rep["1"].f1, 4) == 0.6098
    assert round(rep["accuracy"].f1, 4) == 0.7235
    assert round(rep["macro avg"].precision, 4) == 0.6993 and round(rep["macro avg"].f1, 4) == 0.6979
    assert round(rep["weighted avg"].precision, 4) == 0.7983 and round(rep["weighted avg"].f1, 4) == 0.7391
    assert rep["0"].support == 1033 and rep["1"].support == 374


def test_confusion_cells(spark):
    cm = {(r.actual, r.predicted): r.n for r in ev.confusion_matrix(matrix_frame(spark)).collect()}
    assert cm == {(0, 0): 714, (0, 1): 319, (1, 0): 70, (1, 1): 304}


def scores(spark, n=2000, seed=7, ties=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.randint(0, 1)
        s = min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * y, 0.2)))
        rows.append((f"c{i}", y, round(s, 2) if ties else s + i * 1e-9))
    return spark.createDataFrame(rows, "id string, label int, score double")


def brute_auc(pdf):
    pos = pdf[pdf.label == 1].score.values
    neg = pdf[pdf.label == 0].score.values
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def test_auc_brute_force_and_symmetry(spark):
    df = scores(spark)
    auc = ev.roc_auc(df).first().auc
    assert auc == pytest.approx(brute_auc(df.toPandas()), abs=1e-6)
    flipped = ev.roc_auc(df.withColumn("score", 1 - F.col("score"))).first().auc
    assert auc + flipped == pytest.approx(1.0, abs=2e-6)


def test_average_precision_brute(spark):
    df = scores(spark, ties=False)
    p = df.toPandas().sort_values("score", ascending=False)
    tp = p.label.cumsum().values
    prec = tp / np.arange(1, len(p) + 1)
    ap = (prec * p.label.values).sum() / p.label.sum()
    assert ev.average_precision(df).first().average_precision == pytest.approx(ap, abs=1e-6)


def test_threshold_min_recall_invariant(spark):
    df = scores(spark)
    t = ev.threshold_min_recall(df, min_recall=0.8).first().threshold
    p = df.toPandas()
    P = p.label.sum()
    assert p[(p.score >= t) & (p.label == 1)].shape[0] / P >= 0.8
    higher = sorted(s for s in p.score.unique() if s > t)
    if higher:
        assert p[(p.score >= higher[0]) & (p.label == 1)].shape[0] / P < 0.8


def test_ks_bounds_and_one_class(spark):
    df = scores(spark)
    ks = ev.ks_signed(df).first().ks
    assert 0 <= ks <= 1
    one = df.where("label = 1")
    assert ev.roc_auc(one).first().auc is None
    assert ev.ks_abs(one).first().ks is None


def test_gains_end_at_one(spark):
    g = ev.gains_curve(scores(spark), id_col="id").orderBy(F.desc("pos")).first()
    assert g.cum_base == 1.0 and g.cum_churn == 1.0


def test_roc_has_start_point(spark):
    r = ev.roc_curve(scores(spark, 200)).where(F.col("threshold") == float("inf")).collect()
    assert len(r) == 1 and (r[0].fpr, r[0].tpr) == (0.0, 0.0)


def test_calibration_bins_right_closed(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.2000001), (1, 0.0), (0, 1.0)], "label int, score double")
    got = {r.bin: r.n for r in ev.calibration_curve(df).collect()}
    assert got == {0: 2, 1: 1, 4: 1}
