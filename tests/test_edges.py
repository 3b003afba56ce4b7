"""Scores that are none, margins, NULL classes, boundary ties, malformed text,
contributions of deep trees, layouts of the training table."""
import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest

from attrition.functions.features import numeric_text_to_double
from attrition.operators import economics as eco
from attrition.operators import evaluate as ev
from attrition.operators import explain as xp
from attrition.operators import model as ml
from attrition.operators import primitives as pr
from attrition.operators import profile as pf
from attrition.operators import split as sp
from attrition.operators.scoring import score_with_model
from attrition.plans import queries_model as qm
from attrition.plans import queries_profile as qp

NAN = float("nan")


def test_null_and_nan_scores_count_nowhere(spark):
    good = [("a", 0.9, 1, 1.0), ("b", 0.8, 0, 2.0), ("c", 0.2, 1, 3.0), ("d", 0.1, 0, 4.0)]
    schema = "id string, score double, label int, value double"
    clean = spark.createDataFrame(good, schema)
    dirty = spark.createDataFrame(good + [("e", None, 1, 9.0), ("f", NAN, 1, 9.0)], schema)
    for f in (ev.roc_auc, ev.roc_curve, ev.pr_curve, ev.ks_signed, ev.average_precision, ev.lift_deciles,
              ev.calibration_curve, lambda d: ev.gains_curve(d, "id"), lambda d: ev.gain_at_top(d, "id", p=0.5),
              lambda d: eco.threshold_counts(d, label="label"), lambda d: eco.strategy_efficiency(d, label="label"),
              lambda d: eco.priority_curve(d, id_col="id", revenue="value"),
              lambda d: eco.roi_by_depth(d, id_col="id", revenue="value")):
        assert sorted(map(repr, f(clean).collect())) == sorted(map(repr, f(dirty).collect()))
    pred = {r.id: r.pred for r in ev.apply_threshold(dirty, threshold=0.5).collect()}
    assert pred == {"a": 1, "b": 1, "c": 0, "d": 0, "e": None, "f": None}


def test_margins_spread_over_buckets_and_keep_every_point(spark, monkeypatch):
    monkeypatch.setattr(pr, "BUCKET_ROWS", 100)
    rnd = random.Random(4)
    rows = [(rnd.uniform(-9, 40), rnd.randrange(2)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(4)
    buckets = pr.quantile_buckets(df, "score", 100).groupBy("_b").count().collect()
    assert len(buckets) > 20 and max(r["count"] for r in buckets) < 400
    curve = ev.roc_curve(df).toPandas().sort_values("threshold", ascending=False)
    order = sorted(rows, reverse=True)
    tp = np.cumsum([y for _, y in order])
    assert np.allclose(curve.tpr.values[1:], tp / tp[-1]) and curve.fpr.nunique() > 1900
    y = np.array([y for _, y in order])
    auc = ((1 - y) * tp).sum() / (tp[-1] * (len(y) - tp[-1]))
    assert ev.roc_auc(df).first().auc == pytest.approx(auc, abs=1e-12)


def test_a_null_class_is_a_class(spark):
    rows = [(f"c{i}", None if i % 5 == 0 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, target int")
    got = sp.stratified_split(df, id_col="id", target="target").collect()
    assert len(got) == 40
    assert sum(r.split == "test" for r in got if r.target is None) == 2
    folds = sp.stratified_folds(df, id_col="id", target="target", k=4).collect()
    assert sorted(r.fold for r in folds if r.target is None) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_split_moves_no_row_to_its_class(spark):
    df = spark.range(2000).selectExpr("cast(id AS string) AS id", "int(id % 2) AS target")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sp.stratified_split(df, id_col="id", target="target")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    by_class = [i for i, x in enumerate(lines) if "hashpartitioning(target#" in x and "_b#" not in x]
    assert all("HashAggregate" in lines[i + 1] for i in by_class)     # bucket counts, not rows


@pytest.mark.parametrize("p", [0.0, 0.004, 0.2, 0.5, 1.0])
def test_top_sums_rank_ties_by_hash(spark, p):
    rnd = random.Random(9)
    rows = [(f"k{i}", rnd.choice([0.1, 0.5, 0.5, 0.5, 0.9]), float(i), i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, s double, v double, g int")
    order = sorted(rows, key=lambda r: (-r[1], hashlib.md5(r[0].encode()).hexdigest(), r[0]))
    got = pr.top_sums(df, order="s", id_col="id", values=["v"], fractions=[p]).collect()
    k = math.floor(500 * p)
    assert [(r.k, r.top_v) for r in got] == [(k, sum(r[2] for r in order[:k]))]
    for r in pr.top_sums(df, order="s", id_col="id", values=["v"], fractions=[p], by=["g"]).collect():
        own = [x for x in order if x[3] == r.g]
        assert r.top_v == sum(x[2] for x in own[:math.floor(len(own) * p)])


def test_malformed_numbers(spark):
    texts = ["1.0d", "1f", " 2.5 ", "", "-3", "1e3", ".5", "5.", "Infinity", "abc", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lenient = [r[0] for r in df.select(numeric_text_to_double("t", strict=False)).collect()]
    assert lenient == [None, None, 2.5, None, -3.0, 1000.0, 0.5, 5.0, math.inf, None, None]
    with pytest.raises(Exception, match="not a number"):
        df.limit(1).select(numeric_text_to_double("t")).collect()


def test_change_needs_the_month_before(spark):
    df = spark.createDataFrame([("2024-01-05", 10.0), ("2024-02-01", 15.0), ("2024-04-01", 30.0)],
                               "d string, x double").selectExpr("date(d) AS d", "x")
    got = [r.change for r in eco.revenue_risk_change(df, time_col="d", amount="x").orderBy("month").collect()]
    assert got == [None, 0.5, None]


def _tree(depth, rnd, n_features, cover=1024.0):
    if depth == 0:
        return {"leaf": True, "value": rnd.uniform(-1, 1), "cover": cover}
    left = cover * rnd.uniform(0.2, 0.8)
    return {"leaf": False, "feature": rnd.randrange(n_features), "threshold": rnd.random(), "cover": cover,
            "left": _tree(depth - 1, rnd, n_features, left),
            "right": _tree(depth - 1, rnd, n_features, cover - left)}


def _expected(node, x, known):
    if node["leaf"]:
        return node["value"]
    if node["feature"] in known:
        return _expected(node["left" if x[node["feature"]] <= node["threshold"] else "right"], x, known)
    return sum(node[s]["cover"] / node["cover"] * _expected(node[s], x, known) for s in ("left", "right"))


def test_contributions_against_all_subsets():
    rnd = random.Random(2)
    for _ in range(5):
        tree, n = _tree(3, rnd, 5), 5
        rows = np.array([[rnd.random() for _ in range(n)] for _ in range(4)])
        phi, base = xp.tree_shap(tree, rows)
        for x, got in zip(rows, phi):
            for i in range(n):
                rest = [j for j in range(n) if j != i]
                want = sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                           * (_expected(tree, x, {*s, i}) - _expected(tree, x, set(s)))
                           for k in range(n) for s in itertools.combinations(rest, k))
                assert got[i] == pytest.approx(want, abs=1e-12)
            assert base + got.sum() == pytest.approx(_expected(tree, x, set(range(n))))


def test_contributions_of_a_deep_tree_are_quick():
    rnd = random.Random(6)
    tree, rows = _tree(7, rnd, 30), np.random.default_rng(1).random((200, 30))
    t = time.time()
    phi, base = xp.tree_shap(tree, rows)
    assert time.time() - t < 20
    assert base + phi[0].sum() == pytest.approx(_expected(tree, rows[0], set(range(30))))


def test_model_depends_on_rows_not_on_their_layout(spark):
    rnd = random.Random(8)
    rows = [(f"c{i}", rnd.random(), rnd.random(), f"v{i % 70}", int(rnd.random() < 0.3 + 0.4 * (i % 2)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id string, x double, z double, cat string, target int")
    scores = []
    for layout in (df.repartition(1), df.repartition(5)):
        model = ml.fit_boosted(layout, ["cat"], ["x", "z"], {"maxIter": 3}, weight_col=None, id_col="id")
        scores.append({r.id: r.prob_churn for r in score_with_model(df, model, 0.5).collect()})
    assert scores[0] == scores[1]     # and 70 categories fit


def test_bootstrap_interval_has_a_thousand_replicates(spark):
    sf = "/root/testdata/sf0.001"
    rounded = lambda df: {tuple(round(x, 6) for x in r) for r in df.collect()}
    got = rounded(qp.q_mean_by_target_ci(spark, sf))
    by = {n: rounded(pf.mean_bootstrap_ci(qp.model_df(spark, sf), "tenure", "target", replicates=n))
          for n in (200, 1000)}
    assert got == by[1000] != by[200]


def test_baseline_has_the_external_boosters_defaults(spark, monkeypatch):
    seen, fit = [], ml.fit_boosted

    def quick(train, cat, num, params, **kw):
        seen.append((params["maxIter"], params["maxDepth"], params["stepSize"]))
        return fit(train, cat, num, {**params, "maxIter": 1}, **kw)
    monkeypatch.setattr(qm.ml, "fit_boosted", quick)
    assert qm.q_fit_baseline(spark, "/root/testdata/sf0.001").count() == 2
    assert seen == [(100, 6, 0.3)] * 2
