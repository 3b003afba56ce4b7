"""Search ledger, vocabularies, bootstrap draws, densities, node tables and stream recovery."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attrition.operators import explain as xp
from attrition.operators import model as ml
from attrition.operators import profile as pf
from attrition.operators import split as sp
from attrition.operators.draws import poisson, uniforms
from attrition.operators.evaluate import gains_curve, report
from attrition.operators.search import SearchLedger
from attrition.plans import queries_model as qm
from attrition.plans.base import model_df
from attrition.session import scratch_path
from attrition.sources import io
from attrition.streaming.scoring import score_stream

RANGES = {"maxIter": (2, 4), "maxDepth": (2, 4)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = [(f"k{i}", str(rng.choice(["a", "b", "c"])), float(rng.random() * 10), float(rng.integers(0, 6)))
            for i in range(400)]
    data = [(i, c, x, z, int((x > 6 or c == "b") and rng.random() > .2)) for i, c, x, z in data]
    return spark.createDataFrame(data, "id string, cat string, x double, z double, target int").cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return ml.fit_boosted(rows, ["cat"], ["x", "z"], {"maxIter": 5, "maxDepth": 3}, weight_col=None)


def _ledger(spark, rows, name, **more):
    folds = sp.stratified_folds(rows, id_col="id", target="target", k=2)
    more = {"n_iter": 2, "ranges": RANGES} | more
    return SearchLedger(folds, scratch_path(spark, name), ["cat"], ["x", "z"], id_col="id", weight_col=None, **more)


def test_ledger_resumes_where_a_session_ended(spark, rows):
    one = _ledger(spark, rows, "ledger-a")
    assert one.run() == 0
    first = _ledger(spark, rows, "ledger-b")
    assert first.run(1) == 3 and len(first.open()) == 3
    with pytest.raises(ValueError, match="3 of 4 fits are open"):
        first.best()
    later = _ledger(spark, rows.repartition(7), "ledger-b")       # another session, other layout
    assert len(later.open()) == 3 and later.run(2) == 1 and later.run() == 0
    table = [sorted(map(tuple, x.results().collect())) for x in (one, later)]
    assert table[0] == table[1] and len(table[0]) == 2 and {r[2] for r in table[0]} == {2}
    assert one.best() == later.best() and one.best()[1] == max(r[3] for r in table[0])
    assert len(ml.feature_names(later.refit())) == 3


def test_ledger_keeps_other_searches_apart(spark, rows):
    _ledger(spark, rows, "ledger-b")
    other = _ledger(spark, rows.where("id <> 'k0'"), "ledger-b")
    assert len(other.open()) == 4
    again = _ledger(spark, rows, "ledger-b", seed=43)
    assert len(again.open()) == 4


def test_full_search_has_all_ranges_and_draws():
    params = ml.sample_params(80)
    assert len(params) == 80 and all(set(p) == set(ml.SEARCH_RANGES) for p in params)
    assert params == ml.sample_params(80) and params != ml.sample_params(80, seed=1)
    for name, (lo, hi) in ml.SEARCH_RANGES.items():
        assert all(lo <= float(p[name]) <= hi for p in params)


def test_importance_from_saved_nodes(spark, fitted):
    path = scratch_path(spark, "importance-model")
    io.save_model(fitted, path)
    got = {r["feature"]: r["importance"] for r in ml.feature_importance(
        spark, path, ml.feature_names(fitted), None).collect()}
    want = dict(zip(ml.feature_names(fitted), fitted.stages[-1].featureImportances.toArray()))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert abs(sum(got.values()) - 1) < 1e-12


def test_global_contributions_are_means_of_the_local_ones(rows, fitted):
    got = xp.contributions_global(rows, fitted, id_col="id", top=None)
    want = xp.contributions(rows, fitted, id_col="id").where("feature <> '__bias__'").groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("m"))
    d = got.join(want, "feature").select(F.max(F.abs(F.col("mean_abs") - F.col("m"))), F.count("*")).first()
    assert d[0] < 1e-12 and d[1] == 3


# ------------------------------------------------------------- vocabularies

def test_vocabulary_and_codes(spark):
    data = [(i, v, w) for i, (v, w) in enumerate([("b", "x"), ("a", None), (None, "y"), ("é", "x"), ("a", ""), ("Z", "y")])]
    df = spark.createDataFrame(data, "id int, v string, w string").repartition(3)
    vocab = ml.vocabulary(df, ["v", "w"])
    assert sorted(map(tuple, vocab.collect())) == [("v", "Z", 0), ("v", "a", 1), ("v", "b", 2), ("v", "é", 3),
                                                  ("w", "", 0), ("w", "x", 1), ("w", "y", 2)]
    more = df.unionByName(spark.createDataFrame([(9, "new", "x")], df.schema))
    got = {r["id"]: (r["v_idx"], r["w_idx"]) for r in ml.categorical_encode(more, vocab, ["v", "w"]).collect()}
    assert got == {0: (2, 1), 1: (1, 3), 2: (4, 2), 3: (3, 1), 4: (1, 0), 5: (0, 2), 9: (4, 1)}


def test_vocabulary_of_a_million(spark):
    df = spark.range(1_000_000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("v"))
    codes = ml.categorical_encode(df, ml.vocabulary(df, ["v"]), ["v"])
    r = codes.agg(F.count_distinct("v_idx"), F.min("v_idx"), F.max("v_idx")).first()
    assert tuple(r) == (1_000_000, 0, 999_999)
    some = codes.where("id < 300").orderBy("v").select("v", "v_idx").collect()
    assert [x["v_idx"] for x in some] == sorted(x["v_idx"] for x in some)


# ------------------------------------------------------------- draws, interval, density

def test_poisson_draws_have_the_law():
    u = uniforms(np.arange(50), 4000)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - .5) < .005 and abs(np.corrcoef(u[:2])[0, 1]) < .05
    for rate in (1, 3, 1000, 1_000_003):
        w = poisson(np.full(40, rate), np.arange(40) * 7919, 2500).ravel()
        assert abs(w.mean() / rate - 1) < 4 / math.sqrt(rate * len(w)) and abs(w.var() / rate - 1) < .03
    zero = poisson(np.full(1, 1), np.array([5]), 200_000)
    assert abs((zero == 0).mean() - math.exp(-1)) < .005
    assert not poisson(np.zeros(3, int), np.arange(3), 5).any()


def test_interval_is_the_direct_bootstrap_and_independent_of_layout(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.gamma(2, 10, 900).round(1), "b": np.repeat([1.0, 50.0], [700, 40]), None: rng.normal(5, 1, 60)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: (r["mean"], r["ci_lo"], r["ci_hi"]) for r in pf.mean_bootstrap_ci(df, "v", "g").collect()}
    again = {r["g"]: (r["mean"], r["ci_lo"], r["ci_hi"]) for r in pf.mean_bootstrap_ci(
        df.repartition(13), "v", "g").collect()}
    for g, vs in groups.items():
        direct = np.percentile(rng.choice(vs, (4000, len(vs))).mean(axis=1), [2.5, 97.5])
        width = direct[1] - direct[0]
        assert abs(got[g][0] - vs.mean()) < 1e-9
        assert abs(got[g][1] - direct[0]) < .12 * width and abs(got[g][2] - direct[1]) < .12 * width
        assert np.allclose(got[g], again[g], rtol=1e-12)


def test_interval_of_a_million_values(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    began = time.time()
    r = pf.mean_bootstrap_ci(df, "v", "g").first()
    half = 1.96 * math.sqrt(1 / 12 / 1e6)
    assert abs(r["ci_hi"] - r["ci_lo"] - 2 * half) < .3 * half and time.time() - began < 120


def test_density_by_definition(spark):
    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in rng.normal(3, 2, 300).round(1)] + [(None, float(v)) for v in rng.random(50)]
    data += [("one", 5.0), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    out = pf.kde(df, "v", "g", grid=40)
    got = out.toPandas()
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    pdf = pd.DataFrame(data, columns=["g", "v"]).dropna(subset="v")
    for g in ("a", None):
        v = pdf[pdf.g.isna() if g is None else pdf.g == g].v.to_numpy()
        bw = v.std(ddof=1) * len(v) ** -.2
        x = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 40)
        d = np.exp(-.5 * ((x[:, None] - v) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
        own = got[got.g.isna() if g is None else got.g == g].sort_values("i")
        assert np.allclose(own.x, x) and np.allclose(own.density, d)
    assert not (got.g == "one").any()          # a single value has no bandwidth


# ------------------------------------------------------------- report, gains, stream

def test_report_of_counts(spark):
    r = spark.range(1).select(report(*[F.lit(n) for n in (714, 319, 70, 304)]).alias("r")).first()["r"]
    by = {x["class"]: x for x in r}
    assert round(by["1"]["precision"], 4) == 0.488 and round(by["1"]["recall"], 4) == 0.8128
    assert round(by["accuracy"]["f1"], 4) == 0.7235 and by["accuracy"]["support"] == 1407
    empty = spark.range(1).select(report(*[F.lit(0)] * 4).alias("r")).first()["r"]
    assert [x["f1"] for x in empty] == [0.0] * 5


def test_gains_move_rows_once(spark):
    df = spark.createDataFrame([(f"i{k}", .5 if k % 3 else k / 100, k % 2) for k in range(90)],
                               "id string, score double, label int").repartition(4)
    got = gains_curve(df, "id").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 91)) and got[-1]["cum_churn"] == 1.0
    scores = [r["score"] for r in got]
    assert scores == sorted(scores, reverse=True)


def test_stream_goes_on_after_a_stop(spark, rows, fitted):
    """Stopped after its first batch, started again with a further file: every row
    is scored exactly once."""
    src, out, ckpt = (scratch_path(spark, f"stream-recovery/{x}") for x in ("in", "out", "ckpt"))
    params = {"threshold": 0.5, "min_recall_target_val": 0.8, "id_cols_dropped": ["id"], "drop_cols_global": [],
              "drop_cols_model": [], "cat_cols": None}
    data = rows.drop("target").withColumn("file", F.pmod(F.xxhash64("id"), F.lit(4))).cache()
    part = lambda k: data.where(F.col("file") == k).drop("file").coalesce(1)
    for k in range(3):
        part(k).write.mode("append").parquet(src)
    schema = rows.drop("target").schema
    start = lambda: score_stream(spark, src, schema, fitted, params, out, ckpt, max_files_per_trigger=1)
    q = start()
    limit = time.time() + 60
    while not q.recentProgress and q.isActive and time.time() < limit:
        time.sleep(0.02)
    q.stop()
    some = spark.read.parquet(out).count()
    assert 0 < some <= 400
    part(3).write.mode("append").parquet(src)
    start().awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 400 and got.select("id").distinct().count() == 400
    start().awaitTermination(120)          # nothing new: nothing twice
    assert spark.read.parquet(out).count() == 400


def test_fit_layout_spreads_its_rows(spark):
    rows = spark.range(120_000).select(F.col("id").cast("string").alias("customerid"), "id")
    parts = [ml.fixed_layout(d, "customerid").withColumn("_p", F.spark_partition_id())
             for d in (rows, rows.repartition(7))]
    assert [p.agg(F.countDistinct("_p")).first()[0] for p in parts] == [3, 3]
    a, b = (p.groupBy("_p").agg(F.count("*").alias("n"), F.sum("id").alias("s"), F.first("id").alias("f")) for p in parts)
    assert sorted(a.collect()) == sorted(b.collect())
    assert parts[0].agg(F.count("*"), F.countDistinct("id")).first()[:] == (120_000, 120_000)


def test_model_rows_and_split_are_written_once(spark):
    sf = "/root/testdata/sf0.001"
    rows, split = qm.model_rows(spark, sf), qm.split_df(spark, sf)
    assert model_df(spark, sf).inputFiles() and not rows.inputFiles() and not split.inputFiles()
    assert sorted(map(str, rows.collect())) == sorted(map(str, model_df(spark, sf).collect()))
    assert sorted(r.customerid for r in split.select("customerid").collect()) == sorted(
        r.customerid for r in rows.select("customerid").collect())
    for q in (qm.q_score_form_rows, qm.q_score_customers, qm.q_test_predictions, qm.q_contributions_local):
        assert not q(spark, sf).inputFiles()
