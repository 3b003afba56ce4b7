"""Registered queries: split, encode, fit, tune, score, explain inputs
(SURVEY §2.5, §2.7 model-backed rows, §2.1 model store, streaming)."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate as ev
from ..operators import model as ml
from ..operators import split as sp
from ..operators.clean import FORM_CODE_MAPS, align_to_schema, feature_view, map_codes
from ..operators.primitives import materialize
from ..operators.scoring import risk_band, score_customers, score_with_model
from ..schemas import CATEGORICAL_COLUMNS, MODEL, NUMERIC_COLUMNS
from ..session import scratch_path
from ..sources import io
from ..streaming.scoring import score_stream
from .base import _memo, model_df, scored_df
from .catalog import query
from .sql import with_views

NUM_FEATURES = [c for c in NUMERIC_COLUMNS if c != "target"]
_FITTED: dict = {}

SPLIT_SQL = """
SELECT customerid, target,
       CASE WHEN pos <= kt THEN 'test' WHEN pos <= kt + ceil((n - kt) * 0.25e0) THEN 'val' ELSE 'train' END AS split
FROM (SELECT customerid, target, n, ceil(n * 0.2e0) AS kt, pos
      FROM (SELECT customerid, target, count(*) OVER (PARTITION BY target) AS n,
                   row_number() OVER (PARTITION BY target ORDER BY md5('42' || '|' || customerid),
                                      md5(customerid), customerid) AS pos
            FROM model))"""


def split_df(spark, sf):
    """The model table with its split, written once an application: fit and scores read it
    many times, and each reading would join orders and line items anew. Rows that share an
    id may be split either way, so it is also what keeps readings alike."""
    return _memo("split", spark, sf, lambda: materialize(sp.stratified_split(
        model_df(spark, sf), id_col="customerid", target="target", test=0.2, val=0.25, seed=42)))


def model_rows(spark, sf):
    """The model table as it was written with its split."""
    return split_df(spark, sf).select(*model_df(spark, sf).columns)


def fitted(spark, sf):
    """Fit once per application: weighted booster on the train part,
    threshold from the validation part at recall >= 0.80."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        parts = split_df(spark, sf)
        train = sp.class_weight(parts.where(F.col("split") == "train"), target="target")
        model = ml.fit_boosted(train, CATEGORICAL_COLUMNS, NUM_FEATURES, id_col="customerid")
        scored = score_with_model(parts, model, 0.5)
        val = scored.where(F.col("split") == "val").select(
            F.col("target").alias("label"), F.col("prob_churn").alias("score"))
        thr = ev.threshold_min_recall(val, min_recall=0.8).first()["threshold"]
        params = {"threshold": float(thr), "min_recall_target_val": 0.8,
                  "id_cols_dropped": ["customerid"], "drop_cols_global": [], "drop_cols_model": [],
                  "cat_cols": None}
        _FITTED[key] = (model, params)
    return _FITTED[key]


@query("stratified_split", with_views(SPLIT_SQL))
def q_stratified_split(spark, sf):
    return split_df(spark, sf).select("customerid", "target", "split")


@query("stratified_folds", with_views("""
SELECT customerid, target, CAST((pos - 1) % 5 AS INTEGER) AS fold
FROM (SELECT customerid, target,
             row_number() OVER (PARTITION BY target ORDER BY md5('42' || '|' || customerid),
                                md5(customerid), customerid) AS pos FROM model)"""))
def q_stratified_folds(spark, sf):
    return sp.stratified_folds(model_df(spark, sf), id_col="customerid", target="target", k=5) \
        .select("customerid", "target", "fold")


def _encode_sql() -> str:
    cols = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_idx"
                     for c in CATEGORICAL_COLUMNS)
    return with_views(f"SELECT customerid, {cols} FROM model")


@query("categorical_encode", _encode_sql())
def q_categorical_encode(spark, sf):
    m = model_df(spark, sf)
    enc = ml.categorical_encode(m, ml.vocabulary(m, CATEGORICAL_COLUMNS), CATEGORICAL_COLUMNS)
    return enc.select("customerid", *[c + "_idx" for c in CATEGORICAL_COLUMNS])


@query("class_weight", with_views("""
SELECT neg, pos, round(coalesce(neg / NULLIF(pos, 0), 1e0), 6) AS scale_pos_weight
FROM (SELECT count(*) FILTER (WHERE target = 0) AS neg, count(*) FILTER (WHERE target = 1) AS pos
      FROM (""" + SPLIT_SQL + ") WHERE split = 'train')"))
def q_class_weight(spark, sf):
    return sp.class_weight_summary(split_df(spark, sf).where(F.col("split") == "train"), target="target")


METRICS_SQL = """
SELECT 42 AS seed, 0.8e0 AS min_recall, (SELECT t FROM thr) AS threshold,
       (SELECT auc FROM per WHERE split = 'train') AS auc_train,
       (SELECT auc FROM per WHERE split = 'val') AS auc_val,
       (SELECT auc FROM per WHERE split = 'test') AS auc_test,
       (SELECT ap FROM per WHERE split = 'train') AS ap_train,
       (SELECT ap FROM per WHERE split = 'val') AS ap_val,
       (SELECT ap FROM per WHERE split = 'test') AS ap_test,
       (SELECT ks FROM per WHERE split = 'test') AS ks_test,
       round(coalesce(tp / NULLIF(tp + fp, 0), 0e0), 6) AS precision_test,
       round(coalesce(tp / NULLIF(tp + fn, 0), 0e0), 6) AS recall_test, tn, fp, fn, tp,
       (SELECT r FROM rep WHERE split = 'test') AS report_test, (SELECT r FROM rep WHERE split = 'val') AS report_val
FROM k"""
METRICS_CTES = [
    ("sps", "SELECT s.split, m.target AS label, m.score FROM scored m JOIN (" + SPLIT_SQL
            + ") s USING (customerid)"),
    ("h", "SELECT split, score AS threshold, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos,"
          " count(*) - CAST(sum(label) AS BIGINT) AS neg FROM sps GROUP BY split, score"),
    ("c", "SELECT *, CAST(sum(pos) OVER (PARTITION BY split ORDER BY threshold DESC) AS BIGINT) AS tp,"
          " CAST(sum(neg) OVER (PARTITION BY split ORDER BY threshold DESC) AS BIGINT) AS fp,"
          " CAST(sum(pos) OVER (PARTITION BY split) AS BIGINT) AS tot_pos,"
          " CAST(sum(neg) OVER (PARTITION BY split) AS BIGINT) AS tot_neg FROM h"),
    ("per", "SELECT split,"
            " round(sum(pos * ((tot_neg - fp) + neg / 2e0)) / NULLIF(CAST(max(tot_pos) AS DOUBLE)"
            " * CAST(max(tot_neg) AS DOUBLE), 0), 6) AS auc,"
            " round(sum(pos * (tp / NULLIF(tp + fp, 0))) / NULLIF(max(tot_pos), 0), 6) AS ap,"
            " round(greatest(max(tp / NULLIF(tot_pos, 0) - fp / NULLIF(tot_neg, 0)), 0e0), 6) AS ks"
            " FROM c GROUP BY split"),
    ("thr", "SELECT coalesce(max(threshold) FILTER (WHERE split = 'val' AND tp / NULLIF(tot_pos, 0) >= 0.8e0),"
            " 0e0) AS t FROM c"),
    ("k", "SELECT count(*) FILTER (WHERE label = 0 AND score < t) AS tn,"
          " count(*) FILTER (WHERE label = 0 AND score >= t) AS fp,"
          " count(*) FILTER (WHERE label = 1 AND score < t) AS fn,"
          " count(*) FILTER (WHERE label = 1 AND score >= t) AS tp FROM sps, thr WHERE split = 'test'"),
    ("rep0", "SELECT split, count(*)::DOUBLE AS n, count(*) FILTER (WHERE label = 0)::DOUBLE AS s0,"
             " count(*) FILTER (WHERE label = 1)::DOUBLE AS s1, count(*) FILTER (WHERE score < t)::DOUBLE AS g0,"
             " count(*) FILTER (WHERE score >= t)::DOUBLE AS g1,"
             " count(*) FILTER (WHERE label = 0 AND score < t)::DOUBLE AS tn,"
             " count(*) FILTER (WHERE label = 1 AND score >= t)::DOUBLE AS tp FROM sps, thr GROUP BY split"),
    ("rep1", "SELECT *, coalesce(tn / NULLIF(g0, 0), 0) AS p0, coalesce(tn / NULLIF(s0, 0), 0) AS r0,"
             " coalesce(tp / NULLIF(g1, 0), 0) AS p1, coalesce(tp / NULLIF(s1, 0), 0) AS r1 FROM rep0"),
    ("rep2", "SELECT *, coalesce(2 * p0 * r0 / NULLIF(p0 + r0, 0), 0) AS f0,"
             " coalesce(2 * p1 * r1 / NULLIF(p1 + r1, 0), 0) AS f1 FROM rep1"),
    ("rep", "SELECT split, list_transform([p0, r0, f0, s0, p1, r1, f1, s1, NULL, NULL, (tn + tp) / n, n,"
            " (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n, (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,"
            " (f0 * s0 + f1 * s1) / n, n], lambda x: round(x, 6)) AS r FROM rep2"),
]


def metrics_bundle(df, *, label: str = "label", score: str = "score", split: str = "split",
                   min_recall: float = 0.8, seed: int = 42):
    """One record: seed, recall floor, validation threshold, AUC / AP per split,
    test KS, precision, recall and confusion counts, and the reports by class of the
    test and validation split (``evaluate.report``).

    One curve over all splits is written once; everything is an aggregate of it, as
    a score's prediction follows from the score alone."""
    d = df.select(F.col(split).alias("split"), F.col(label).alias("label"), F.col(score).alias("score"))
    c = materialize(ev.score_curve(d, by=["split"]))

    def div(a, b):
        return F.try_divide(a.cast("double"), b.cast("double"))
    recall, fall = div(F.col("tp"), F.col("tot_pos")), div(F.col("fp"), F.col("tot_neg"))
    per = materialize(c.groupBy("split").agg(
        div(F.sum(F.col("pos") * (F.col("tot_neg") - F.col("fp") + F.col("neg") / 2.0)),
            F.first("tot_pos").cast("double") * F.first("tot_neg").cast("double")).alias("auc"),
        div(F.sum(F.col("pos") * div(F.col("tp"), F.col("tp") + F.col("fp"))), F.first("tot_pos")).alias("ap"),
        F.greatest(F.max(recall - fall), F.lit(0.0)).alias("ks"),
        F.coalesce(F.max(F.when(recall >= min_recall, F.col("threshold"))), F.lit(0.0)).alias("thr")))
    wide = per.agg(F.max(F.when(F.col("split") == "val", F.col("thr"))).alias("threshold"),
                   *[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{m}_{s}")
                     for m, s in [("auc", "train"), ("auc", "val"), ("auc", "test"), ("ap", "train"), ("ap", "val"),
                                  ("ap", "test"), ("ks", "test")]])
    t = wide.select("threshold").scalar()
    hit = F.col("threshold") >= t
    cells = c.where(F.col("split").isin("test", "val")).groupBy("split").agg(*[
        F.coalesce(F.sum(F.when(hit if p else ~hit, F.col(y))), F.lit(0)).alias(n)
        for n, p, y in (("tn", 0, "neg"), ("fp", 1, "neg"), ("fn", 0, "pos"), ("tp", 1, "pos"))])
    counts = [F.col(n) for n in ("tn", "fp", "fn", "tp")]
    of = {x: F.max(F.when(F.col("split") == x, F.struct(*counts, ev.report(*counts).alias("report")))).alias(x)
          for x in ("test", "val")}
    one = wide.select(F.struct(*wide.columns).alias("w")).scalar()
    both = cells.agg(*of.values()).withColumn("w", one).select(
        "w", *[F.coalesce(f"test.{n}", F.lit(0)).alias(n) for n in ("tn", "fp", "fn", "tp")],
        *[F.col(f"{x}.report").alias(f"report_{x}") for x in of])
    return both.select(
        F.lit(seed).alias("seed"), F.lit(min_recall).alias("min_recall"), *[f"w.{x}" for x in wide.columns],
        F.coalesce(div(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision_test"),
        F.coalesce(div(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall_test"),
        "tn", "fp", "fn", "tp", "report_test", "report_val")


@query("metrics_bundle", with_views(METRICS_SQL, *METRICS_CTES))
def q_metrics_bundle(spark, sf):
    s = split_df(spark, sf).select("customerid", "split")
    d = scored_df(spark, sf).join(s, "customerid").select(
        "split", F.col("target").alias("label"), "score")
    # the reports as numbers: precision, recall, f1 and support of each of their rows
    return metrics_bundle(d).withColumns({c: F.flatten(F.transform(c, lambda r: F.array(*[
        F.round(r[x].cast("double"), 6) for x in ("precision", "recall", "f1", "support")])))
        for c in ("report_test", "report_val")})


# ---------------------------------------------------------------- model-backed (rows checks)

def _code_sql(c: str) -> str:
    """Place of a category among those of the training part, in their order; unseen
    ones come behind all."""
    return (f"(CASE WHEN EXISTS (SELECT 1 FROM tr t WHERE t.{c} = m.{c})"
            f" THEN (SELECT count(DISTINCT t.{c}) FROM tr t WHERE t.{c} < m.{c})"
            f" ELSE (SELECT count(DISTINCT t.{c}) FROM tr t) END)")


_TRAIN_CTE = ("tr", "SELECT m.* FROM model m JOIN (" + SPLIT_SQL + ") s USING (customerid) WHERE s.split = 'train'")
_VALUES = [*[f"CAST(m.{c} AS DOUBLE)" for c in NUM_FEATURES], *[f"CAST({_code_sql(c)} AS DOUBLE)"
                                                               for c in CATEGORICAL_COLUMNS]]


@query("assemble_features", with_views(
    f"SELECT customerid, target, [{', '.join(_VALUES)}] AS features FROM model m", _TRAIN_CTE))
def q_assemble_features(spark, sf):
    model, _ = fitted(spark, sf)
    pre = model.stages[:-1]
    x = model_rows(spark, sf)
    for st in pre:
        x = st.transform(x)
    return x.select("customerid", F.col("target").cast("int").alias("target"),
                    vector_to_array("features").alias("features"))


@query("fit_baseline")
def q_fit_baseline(spark, sf):
    """Default booster, unweighted, then weighted: test AUC of each."""
    parts = split_df(spark, sf)
    train = ml.fixed_layout(sp.class_weight(parts.where(F.col("split") == "train"), target="target"), "customerid")
    test = parts.where(F.col("split") == "test")
    out = None
    for name, w in (("unweighted", None), ("weighted", "weight")):
        m = ml.fit_boosted(train, CATEGORICAL_COLUMNS, NUM_FEATURES,
                           {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3,
                            "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}, weight_col=w)
        s = score_with_model(test, m, 0.5).select(F.col("target").alias("label"),
                                                  F.col("prob_churn").alias("score"))
        r = ev.roc_auc(s).select(F.lit(name).alias("model"), "auc")
        out = r if out is None else out.unionByName(r)
    return out


@query("fit_boosted")
def q_fit_boosted(spark, sf):
    """Tuned, weighted booster: AUC per split."""
    model, params = fitted(spark, sf)
    s = score_with_model(split_df(spark, sf), model, params["threshold"]).select(
        "split", F.col("target").alias("label"), F.col("prob_churn").alias("score"))
    return ev.roc_auc(s, by=["split"])


_SAVED: dict = {}


def _saved(spark, sf) -> str:
    """Where the fitted model is saved; once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAVED:
        _SAVED[key] = scratch_path(spark, f"model-{uuid.uuid4().hex[:12]}")
        io.save_model(fitted(spark, sf)[0], _SAVED[key])
    return _SAVED[key]


def _importance(spark, sf, top):
    return ml.feature_importance(spark, _saved(spark, sf), ml.feature_names(fitted(spark, sf)[0]), top)


@query("feature_importance")
def q_feature_importance(spark, sf):
    return _importance(spark, sf, 10)


@query("score_customers")
def q_score_customers(spark, sf):
    model, params = fitted(spark, sf)
    out = score_customers(model_rows(spark, sf).drop("target"), model, params)
    return risk_band(out, score="prob_churn").select("customerid", "prob_churn", "pred_churn",
                                                     "threshold_used", "risk_band")


@query("test_predictions")
def q_test_predictions(spark, sf):
    model, params = fitted(spark, sf)
    test = split_df(spark, sf).where(F.col("split") == "test")
    s = score_with_model(test, model, params["threshold"])
    return s.select("customerid", F.col("target").alias("y_true"), "prob_churn", "pred_churn")


def _form_rows(spark, sf):
    """Model rows expressed in form labels (inverse code maps), as the
    scoring form would submit them."""
    m = model_rows(spark, sf)
    inv = {c: {v: k for k, v in mp.items()} for c, mp in FORM_CODE_MAPS.items()}
    return map_codes(m, inv)


@query("score_form_rows")
def q_score_form_rows(spark, sf):
    model, params = fitted(spark, sf)
    form = _form_rows(spark, sf)
    coded = map_codes(form, FORM_CODE_MAPS)
    feats = feature_view(coded)
    aligned = align_to_schema(feats, MODEL).drop("target")
    out = score_customers(aligned, model, params)
    return out.select("customerid", "prob_churn", "pred_churn")


@query("score_stream")
def q_score_stream(spark, sf):
    model, params = fitted(spark, sf)
    run = uuid.uuid4().hex[:12]
    src = scratch_path(spark, f"stream-{run}/in")
    out = scratch_path(spark, f"stream-{run}/out")
    ckpt = scratch_path(spark, f"stream-{run}/ckpt")
    batch = model_rows(spark, sf).drop("target")
    io.write_table(batch, src, "parquet")
    q = score_stream(spark, src, batch.schema, model, params, out, ckpt)
    q.awaitTermination()
    return spark.read.parquet(out).select("customerid", "prob_churn", "pred_churn", "risk_band")


@query("model_store")
def q_model_store(spark, sf):
    model, params = fitted(spark, sf)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex[:12]}")
    io.save_model(model, path)
    loaded = io.load_model(path)
    test = split_df(spark, sf).where(F.col("split") == "test").drop("split")
    return score_with_model(test, loaded, params["threshold"]).select("customerid", "prob_churn", "pred_churn")


# ---------------------------------------------------------------- explanation (§2.9)

from ..operators import explain as xp  # noqa: E402

# The linear terms of the formula score (logit scale).
FORMULA_TERMS_SQL = [
    ("contract_m2m", "CASE WHEN contract = 'Month-to-month' THEN 1.2e0 ELSE 0e0 END"),
    ("tenure", "-0.03e0 * tenure"),
    ("monthlycharges", "0.01e0 * monthlycharges"),
    ("total_services", "-0.15e0 * total_services"),
]


def _formula_terms():
    return [("contract_m2m", F.when(F.col("contract") == "Month-to-month", 1.2).otherwise(0.0)),
            ("tenure", F.lit(-0.03) * F.col("tenure")),
            ("monthlycharges", F.lit(0.01) * F.col("monthlycharges")),
            ("total_services", F.lit(-0.15) * F.col("total_services"))]


_TERMS_UNION = " UNION ALL ".join(
    f"SELECT customerid, '{n}' AS feature, CAST({e} AS DOUBLE) AS contribution FROM model"
    for n, e in FORMULA_TERMS_SQL)


@query("top_factors", with_views("""
SELECT customerid, CAST(rk AS INTEGER) AS rank, feature, round(contribution, 6) AS contribution,
       CASE WHEN contribution > 0 THEN '↑ aumenta churn' ELSE '↓ reduz churn' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY customerid ORDER BY abs(contribution) DESC, feature) AS rk
      FROM lc) WHERE rk <= 3""", ("lc", _TERMS_UNION)))
def q_top_factors(spark, sf):
    long = xp.formula_contributions(model_df(spark, sf), id_col="customerid", terms=_formula_terms())
    return xp.top_factors(long, id_col="customerid", n=3)


@query("contributions_local")
def q_contributions_local(spark, sf):
    model, _ = fitted(spark, sf)
    return xp.contributions(model_rows(spark, sf), model, id_col="customerid") \
        .select("customerid", "feature", F.round("contribution", 9).alias("contribution"))


@query("contributions_global")
def q_contributions_global(spark, sf):
    model, _ = fitted(spark, sf)
    return xp.contributions_global(model_rows(spark, sf), model, id_col="customerid", top=15) \
        .select("feature", F.round("mean_abs", 9).alias("mean_abs"), "rank")


@query("feature_space", with_views(
    "SELECT customerid, f.feature AS feature, f.value AS value FROM (SELECT customerid, unnest(["
    + ", ".join(f"{{'feature': '{c}', 'value': {v}}}" for c, v in
                zip([*NUM_FEATURES, *CATEGORICAL_COLUMNS], _VALUES)) + "]) AS f FROM model m)", _TRAIN_CTE))
def q_feature_space(spark, sf):
    model, _ = fitted(spark, sf)
    names = ml.feature_names(model)
    x = xp._features_frame(model_rows(spark, sf), model, "customerid")
    return x.select("customerid", F.posexplode("_x").alias("i", "value")).withColumn(
        "feature", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)).select(
        "customerid", "feature", "value")


# ---------------------------------------------------------------- checks of what a model makes

_TEST_ROWS = "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM (" + SPLIT_SQL + ") WHERE split = 'test'"
_MODEL_ROWS = "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM model"


def _mismatches(got, want, key, bad):
    """Rows of ``got`` and how many of them, or of ``want``, have no equal row."""
    w = want.withColumnsRenamed({c: f"w_{c}" for c in want.columns})
    j = got.join(w, F.col(key) == F.col(f"w_{key}"), "full_outer")
    wrong = F.col(key).isNull() | F.col(f"w_{key}").isNull() | bad
    return j.agg(F.count(F.col(key)).alias("rows"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("mismatches"))


@query("model_store_check", with_views(_TEST_ROWS))
def q_model_store_check(spark, sf):
    """Scores of the saved and reloaded model against those of the fitted one."""
    want = q_test_predictions(spark, sf).select("customerid", "prob_churn", "pred_churn")
    return _mismatches(q_model_store(spark, sf), want, "customerid",
                       (F.col("prob_churn") != F.col("w_prob_churn")) | (F.col("pred_churn") != F.col("w_pred_churn")))


@query("score_stream_check", with_views(_MODEL_ROWS))
def q_score_stream_check(spark, sf):
    """Scores of the stream against those of the batch."""
    want = q_score_customers(spark, sf).select("customerid", "prob_churn", "risk_band")
    return _mismatches(q_score_stream(spark, sf), want, "customerid",
                       (F.col("prob_churn") != F.col("w_prob_churn")) | (F.col("risk_band") != F.col("w_risk_band")))


@query("score_form_check", with_views(_MODEL_ROWS))
def q_score_form_check(spark, sf):
    """Rows that went through the form's labels score like the table's own."""
    want = q_score_customers(spark, sf).select("customerid", "prob_churn")
    return _mismatches(q_score_form_rows(spark, sf), want, "customerid", F.col("prob_churn") != F.col("w_prob_churn"))


@query("score_check", with_views(_MODEL_ROWS))
def q_score_check(spark, sf):
    """Probabilities lie in [0, 1] and predictions follow from the threshold."""
    s = q_score_customers(spark, sf)
    ok = F.col("prob_churn").between(0, 1) & (
        F.col("pred_churn") == (F.col("prob_churn") >= F.col("threshold_used")).cast("int"))
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("mismatches"))


@query("contributions_check", with_views(_MODEL_ROWS))
def q_contributions_check(spark, sf):
    """Bias and contributions of every customer add up to the model's log-odds."""
    model, _ = fitted(spark, sf)
    sums = xp.contributions(model_rows(spark, sf), model, id_col="customerid").groupBy("customerid").agg(
        F.sum("contribution").alias("total"))
    want = xp.margin(model_rows(spark, sf), model, id_col="customerid")
    return _mismatches(sums, want, "customerid", F.abs(F.col("total") - F.col("w_margin")) > 1e-9)


_FEATURE_ROWS = (f"SELECT CAST({len(NUM_FEATURES) + len(CATEGORICAL_COLUMNS)} AS BIGINT) AS rows,"
                 " CAST(0 AS BIGINT) AS mismatches")


@query("feature_importance_check", _FEATURE_ROWS)
def q_feature_importance_check(spark, sf):
    """Importances added up from the saved nodes against the fitted model's own vector."""
    model, _ = fitted(spark, sf)
    own = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    want = spark.createDataFrame(list(zip(ml.feature_names(model), own)), "feature string, importance double")
    return _mismatches(_importance(spark, sf, None).drop("rank"), want, "feature",
                       F.abs(F.col("importance") - F.col("w_importance")) > 1e-9)


@query("contributions_global_check", _FEATURE_ROWS)
def q_contributions_global_check(spark, sf):
    """Means added up inside the tasks against means over the long table."""
    model, _ = fitted(spark, sf)
    m = model_rows(spark, sf)
    want = xp.contributions(m, model, id_col="customerid").where(F.col("feature") != "__bias__").groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"))
    got = xp.contributions_global(m, model, id_col="customerid", top=None).drop("rank")
    return _mismatches(got, want, "feature", F.abs(F.col("mean_abs") - F.col("w_mean_abs")) > 1e-9)


@query("model_top_factors")
def q_model_top_factors(spark, sf):
    """The five strongest contributions of the model to every customer's score."""
    model, _ = fitted(spark, sf)
    return xp.top_factors(xp.contributions(model_rows(spark, sf), model, id_col="customerid"),
                          id_col="customerid", n=5)


@query("model_top_factors_check", with_views(
    "SELECT count(*) * 5 AS rows, CAST(0 AS BIGINT) AS mismatches FROM model"))
def q_model_top_factors_check(spark, sf):
    """Ranks run from 1 to 5 in order of size and directions follow from the sign."""
    t = q_model_top_factors(spark, sf)
    per = t.groupBy("customerid").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.abs("contribution").alias("size"), (F.col("contribution") > 0).alias("up"), "direction"))).alias("x"))
    ok = F.forall("x", lambda r: F.when(r["up"], xp.RAISES).otherwise(xp.LOWERS) == r["direction"]) & F.forall(
        F.sequence(F.lit(1), F.lit(4)), lambda i: F.get("x", i - 1)["size"] >= F.get("x", i)["size"])
    return per.agg(F.sum(F.size("x")).alias("rows"), F.count_if((F.size("x") != 5) | ~ok).alias("mismatches"))


# ---------------------------------------------------------------- the two entry chains

def _train_run(spark, sf, path):
    """Fit, threshold, metrics and lift on the model's scores, test predictions; all
    written below ``path``."""
    model, params = fitted(spark, sf)
    scored = materialize(score_with_model(split_df(spark, sf), model, params["threshold"]))
    d = scored.select("customerid", "split", F.col("target").alias("label"), F.col("prob_churn").alias("score"))
    io.save_model(model, f"{path}/model")
    io.write_params(io.params_frame(spark, params), f"{path}/params")
    io.write_params(metrics_bundle(d), f"{path}/metrics")
    test = scored.where(F.col("split") == "test")
    io.write_table(test.select("customerid", F.col("target").alias("y_true"), "prob_churn", "pred_churn"),
                   f"{path}/predictions", "csv")
    io.write_table(ev.lift_deciles(d.where(F.col("split") == "test")), f"{path}/lift", "csv")


@query("train_run")
def q_train_run(spark, sf):
    """The training chain; returns the lift table it has written."""
    path = scratch_path(spark, f"train-{uuid.uuid4().hex[:12]}")
    _train_run(spark, sf, path)
    return io.read_table(spark, f"{path}/lift", T.StructType.fromDDL(
        "decil int, total long, churn long, churn_rate double, lift double, baseline double"), "csv")


@query("train_run_check", with_views(
    "SELECT count(*) AS customers, CAST(sum(target) AS BIGINT) AS churners FROM (" + SPLIT_SQL + ") WHERE split = 'test'"))
def q_train_run_check(spark, sf):
    """The lift table of the chain holds every customer and churner of the test part."""
    return q_train_run(spark, sf).agg(F.sum("total").alias("customers"), F.sum("churn").alias("churners"))


@query("predict_run")
def q_predict_run(spark, sf):
    """The scoring chain: new customers from CSV, the saved model and parameters,
    scored customers to CSV."""
    path = scratch_path(spark, f"predict-{uuid.uuid4().hex[:12]}")
    _train_run(spark, sf, path)
    new = model_rows(spark, sf).drop("target")
    io.write_table(new, f"{path}/new", "csv")
    params = io.params_dict(io.read_params(spark, f"{path}/params"))
    rows = io.read_table(spark, f"{path}/new", new.schema, "csv")
    out = score_customers(rows, io.load_model(f"{path}/model"), params)
    done = out.select("customerid", "prob_churn", "pred_churn", "threshold_used")
    return io.round_trip(done, f"{path}/scored", "csv")


@query("predict_run_check", with_views(_MODEL_ROWS))
def q_predict_run_check(spark, sf):
    """Scores of the chain against those of the model in memory."""
    want = q_score_customers(spark, sf).select("customerid", "prob_churn", "pred_churn")
    return _mismatches(q_predict_run(spark, sf), want, "customerid",
                       (F.col("prob_churn") != F.col("w_prob_churn")) | (F.col("pred_churn") != F.col("w_pred_churn")))
