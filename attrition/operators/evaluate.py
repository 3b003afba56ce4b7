"""Evaluation of a score table (label, score[, id, value]).

Every threshold metric is computed from the score histogram H with a
distributed running sum (see ``primitives``); per-row outputs (gains) use
``running_rows``. ``by`` evaluates several splits in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .primitives import (
    exact_quantiles,
    join_groups,
    materialize,
    prefix_sums,
    running_rows,
    score_histogram,
    top_sums,
    valid,
    with_totals,
)

def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


# ----------------------------------------------------------------- curves

def score_curve(df: DataFrame, label: str = "label", score: str = "score",
                by: Sequence[str] = ()) -> DataFrame:
    """H in descending score order with cumulative tp / fp and class totals.

    Columns: by..., threshold, n, pos, neg, tp, fp, tot_pos, tot_neg.
    """
    h0 = materialize(score_histogram(df, score, label, by=by))
    h = prefix_sums(h0, [(score, False)], ["pos", "neg"], by=by, ready=True)
    h = with_totals(h, h0, {"tot_pos": F.sum("pos"), "tot_neg": F.sum("neg")}, by)
    return h.select(*by, F.col(score).alias("threshold"), "n", "pos", "neg",
                    F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "tot_pos", "tot_neg")


def score_histogram_table(df: DataFrame, label: str = "label", score: str = "score",
                          by: Sequence[str] = ()) -> DataFrame:
    c = score_curve(df, label, score, by)
    return c.select(*by, F.col("threshold").alias("score"), "n", "pos", "neg", "tp", "fp")


def roc_curve(df: DataFrame, label: str = "label", score: str = "score",
              by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the (0, 0) start
    at threshold +inf. All points are kept."""
    c = score_curve(df, label, score, by)
    pts = c.select(*by, "threshold", _div(F.col("fp"), F.col("tot_neg")).alias("fpr"),
                   _div(F.col("tp"), F.col("tot_pos")).alias("tpr"))
    start = c.select(*by).distinct().select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            by: Sequence[str] = ()) -> DataFrame:
    """Area under ROC by rank sum over H; a tie counts one half.

    auc = sum(pos * (neg strictly below + neg / 2)) / (P * N); NULL when a
    class is empty."""
    c = score_curve(df, label, score, by)
    below = F.col("tot_neg") - F.col("fp")  # negatives with a lower score
    contrib = F.col("pos") * (below + F.col("neg") / 2.0)
    return c.groupBy(*by).agg(
        _div(F.sum(contrib),
                F.first("tot_pos").cast("double") * F.first("tot_neg").cast("double")).alias("auc"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score",
             by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the final
    point (precision 1, recall 0) with a NULL threshold. Recall is 1 for
    all thresholds when there is no positive."""
    c = score_curve(df, label, score, by)
    recall = F.when(F.col("tot_pos") == 0, F.lit(1.0)).otherwise(_div(F.col("tp"), F.col("tot_pos")))
    pts = c.select(*by, "threshold", _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                   recall.alias("recall"))
    end = c.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      by: Sequence[str] = ()) -> DataFrame:
    """AP = sum over thresholds of (recall step) * precision (no
    interpolation)."""
    c = score_curve(df, label, score, by)
    step = F.col("pos") * _div(F.col("tp"), F.col("tp") + F.col("fp"))
    return c.groupBy(*by).agg(_div(F.sum(step), F.first("tot_pos")).alias("average_precision"))


def ks_curve(df: DataFrame, label: str = "label", score: str = "score",
             by: Sequence[str] = ()) -> DataFrame:
    """ROC points with gap = tpr - fpr (the table behind the KS plot)."""
    r = roc_curve(df, label, score, by)
    return r.withColumn("gap", F.col("tpr") - F.col("fpr"))


def ks_signed(df: DataFrame, label: str = "label", score: str = "score",
              by: Sequence[str] = ()) -> DataFrame:
    """KS = max(tpr - fpr) over the ROC (>= 0 thanks to the start point) and
    the threshold of its first occurrence (the highest such threshold)."""
    c = score_curve(df, label, score, by)
    gap = _div(F.col("tp"), F.col("tot_pos")) - _div(F.col("fp"), F.col("tot_neg"))
    pts = c.select(*by, "threshold", gap.alias("gap"))
    best = pts.groupBy(*by).agg(F.max(F.struct(F.col("gap"), F.col("threshold"))).alias("b"))
    ks = F.greatest(F.col("b.gap"), F.lit(0.0))
    thr = F.when(F.col("b.gap") > 0, F.col("b.threshold")).otherwise(F.lit(float("inf")))
    return best.select(*by, ks.alias("ks"), thr.alias("ks_threshold"))


def ks_abs(df: DataFrame, label: str = "label", score: str = "score",
           by: Sequence[str] = ()) -> DataFrame:
    """max |CDF+ - CDF-| over ascending distinct scores, and the smallest
    score where it is reached; NULLs when a class is empty."""
    h0 = materialize(score_histogram(df, score, label, by=by))
    h = prefix_sums(h0, [(score, True)], ["pos", "neg"], by=by, ready=True)
    h = with_totals(h, h0, {"tot_pos": F.sum("pos"), "tot_neg": F.sum("neg")}, by)
    d = F.abs(_div(F.col("cum_pos"), F.col("tot_pos")) - _div(F.col("cum_neg"), F.col("tot_neg")))
    pts = h.select(*by, F.col(score).alias("s"), d.alias("d"), "tot_pos", "tot_neg")
    best = pts.groupBy(*by).agg(
        F.max(F.struct(F.col("d").alias("d"), (-F.col("s")).alias("ns"))).alias("b"), F.first("tot_pos").alias("tot_pos"),
        F.first("tot_neg").alias("tot_neg"))
    ok = (F.col("tot_pos") > 0) & (F.col("tot_neg") > 0)
    return best.select(*by, F.when(ok, F.col("b.d")).alias("ks"),
                       F.when(ok, -F.col("b.ns")).alias("ks_at"))


def threshold_min_recall(df: DataFrame, label: str = "label", score: str = "score",
                         min_recall: float = 0.80, by: Sequence[str] = ()) -> DataFrame:
    """Largest threshold whose recall is at least ``min_recall``; 0.0 when
    none qualifies."""
    c = score_curve(df, label, score, by)
    ok = _div(F.col("tp"), F.col("tot_pos")) >= F.lit(float(min_recall))
    return c.groupBy(*by).agg(
        F.coalesce(F.max(F.when(ok, F.col("threshold"))), F.lit(0.0)).alias("threshold"))


def pr_balance_point(df: DataFrame, label: str = "label", score: str = "score",
                     by: Sequence[str] = ()) -> DataFrame:
    """First threshold (ascending) after which sign(precision - recall)
    changes; the final (1, 0) point counts as the last curve point.

    With s0 the sign at the lowest threshold, the answer is the point just
    before the first threshold whose sign differs from s0 — all aggregates,
    no ordered window over the curve."""
    c = score_curve(df, label, score, by)
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.when(F.col("tot_pos") == 0, F.lit(1.0)).otherwise(_div(F.col("tp"), F.col("tot_pos")))
    pts = c.select(*by, "threshold", prec.alias("precision"), rec.alias("recall"),
                   F.signum(F.coalesce(prec, F.lit(0.0)) - rec).alias("sg"))
    s0 = pts.groupBy(*by).agg(F.min_by("sg", "threshold").alias("s0"),
                              F.max("threshold").alias("tmax"))
    j = pts.join(s0, list(by)) if by else with_totals(pts, pts, {
        "s0": F.min_by("sg", "threshold"), "tmax": F.max("threshold")})
    first_change = j.groupBy(*by).agg(
        F.min(F.when(F.col("sg") != F.col("s0"), F.col("threshold"))).alias("tj"),
        F.first("s0").alias("s0"), F.first("tmax").alias("tmax"))
    j2 = pts.join(first_change, list(by)) if by else with_totals(pts, first_change, {
        "tj": F.first("tj"), "s0": F.first("s0"), "tmax": F.first("tmax")})
    # the point just below tj; when no curve point changes sign, the final
    # (1, 0) point (sign +1) changes it unless s0 is already +1
    target = F.when(F.col("tj").isNotNull(), F.lit(True)).otherwise(F.col("s0") != 1.0)
    cand = j2.where(target & (F.col("tj").isNull() | (F.col("threshold") < F.col("tj"))))
    pick = cand.groupBy(*by).agg(F.max("threshold").alias("threshold"))
    return (pick.join(pts, [*by, "threshold"])
            .select(*by, "threshold", F.col("precision").alias("precision"),
                    F.col("recall").alias("recall")))


# ----------------------------------------------------------------- thresholded

def apply_threshold(df: DataFrame, score: str = "score", threshold: float | Column = 0.5,
                    out: str = "pred", strict: bool = False) -> DataFrame:
    """Prediction 1 at or above (``strict``: above) the threshold, else 0; NULL
    without a valid score, which no count below takes in."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    cmp = F.col(score) > t if strict else F.col(score) >= t
    return df.withColumn(out, F.when(valid(df, score), cmp.cast("int")))


def _counts(df: DataFrame, label: str, pred: str, by: Sequence[str]) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred",
                     by: Sequence[str] = ()) -> DataFrame:
    """Long 2x2 table (actual, predicted, n), zero cells included."""
    c = _counts(df, label, pred, by)
    return c.selectExpr(*by, "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp)"
                        " AS (actual, predicted, n)")


def confusion_normalized(df: DataFrame, label: str = "label", pred: str = "pred",
                         by: Sequence[str] = ()) -> DataFrame:
    """Row-normalised matrix (share of each actual class)."""
    c = _counts(df, label, pred, by)
    neg, pos = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    c = c.select(*by, *[_div(F.col(k), d).alias(k) for k, d in
                        [("tn", neg), ("fp", neg), ("fn", pos), ("tp", pos)]])
    return c.selectExpr(*by, "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp)"
                        " AS (actual, predicted, share)")


def precision_recall_at(df: DataFrame, label: str = "label", score: str = "score",
                        threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at ``threshold``; 0 when a denominator is 0."""
    c = _counts(apply_threshold(df, score, threshold), label, "pred", by)
    prec = F.coalesce(_div(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(_div(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return c.select(*by, F.lit(float(threshold)).alias("threshold"), prec.alias("precision"),
                    rec.alias("recall"), "tp", "fp", "fn", "tn")


def report(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """The report of four counts as an array of structs (class, precision, recall, f1,
    support): '0', '1', 'accuracy', 'macro avg', 'weighted avg'; zero division -> 0."""
    z = F.lit(0.0)
    none = F.lit(None).cast("double")

    def f1(p: Column, r: Column) -> Column:
        return F.coalesce(_div(2 * p * r, p + r), z)

    def row(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        support.cast("long").alias("support"))

    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    p0, r0 = F.coalesce(_div(tn, tn + fn), z), F.coalesce(_div(tn, s0), z)
    p1, r1 = F.coalesce(_div(tp, tp + fp), z), F.coalesce(_div(tp, s1), z)
    w0, w1 = F.coalesce(_div(s0, n), z), F.coalesce(_div(s1, n), z)
    f0, g1 = f1(p0, r0), f1(p1, r1)
    return F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, g1, s1),
        row("accuracy", none, none, F.coalesce(_div(tp + tn, n), z), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + g1) / 2, n),
        row("weighted avg", p0 * w0 + p1 * w1, r0 * w0 + r1 * w1, f0 * w0 + g1 * w1, n))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred",
                          by: Sequence[str] = ()) -> DataFrame:
    """Rows '0', '1', 'accuracy', 'macro avg', 'weighted avg' with
    precision, recall, f1 and support (zero division -> 0)."""
    c = _counts(df, label, pred, by)
    return c.select(*by, F.inline(report(*map(F.col, ("tn", "fp", "fn", "tp")))))


# ----------------------------------------------------------------- bins

def binned_histogram(df: DataFrame, label: str = "label", score: str = "score", n_bins: int = 10,
                     by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Quantile bins computed on the score histogram: a bin depends only on
    the score, so (score -> n, pos) rows carry everything. The histogram is
    materialised once; edges, bins and totals read it, not the raw rows.

    Columns: by..., score, n, pos, _sv (score * n), edges, _bin."""
    h = materialize(score_histogram(df, score, label, by=by)
                    .withColumn("_sv", F.col(score) * F.col("n")))
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(h, score, probs, by=by, weight="n", ready=True)
    e = q.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pi", "q"))).alias("_e")) \
        .select(*by, F.transform("_e", lambda s: s["q"]).alias("edges"))
    if strict:
        e = e.withColumn("edges", F.when(
            F.size(F.array_distinct("edges")) == F.size("edges"), F.col("edges"))
            .otherwise(F.raise_error(F.lit("quantile edges are not unique")).cast("array<double>")))
    e = e.withColumn("edges", F.array_distinct("edges"))
    j = join_groups(h, e, by) if by else with_totals(h, e, {"edges": F.first("edges")})
    inner = F.slice(F.col("edges"), 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return j.withColumn("_bin", F.size(F.filter(inner, lambda x: x < F.col(score))).cast("int"))


def lift_deciles(df: DataFrame, label: str = "label", score: str = "score", n_bins: int = 10,
                 by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Per bin (0 = riskiest): total, churn, churn_rate, lift, baseline.
    A zero baseline divides by 1e-9."""
    binned = binned_histogram(df, label, score, n_bins, by, strict=strict)
    # at most n_bins rows a group, read twice: written once
    t = materialize(binned.groupBy(*by, "_bin").agg(F.sum("n").alias("total"), F.sum("pos").alias("churn")))
    # The highest observed bin index is the reference point for "max - bin".
    t = with_totals(t, t, {"_T": F.sum("total"), "_C": F.sum("churn"), "_mb": F.max("_bin")}, by)
    base = _div(F.col("_C"), F.col("_T"))
    rate = _div(F.col("churn"), F.col("total"))
    decil = (F.lit(n_bins - 1) - F.col("_bin")) if strict else (F.col("_mb") - F.col("_bin"))
    return t.select(*by, decil.cast("int").alias("decil"), "total", "churn",
                    rate.alias("churn_rate"),
                    (rate / F.when(base > 0, base).otherwise(F.lit(1e-9))).alias("lift"),
                    base.alias("baseline"))


def _percent(x: Column) -> Column:
    """A share of 0 or more as percent with one decimal, rounded half up in whole numbers."""
    tenths = F.round(x * 1000).cast("long")
    return F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def decile_table(df: DataFrame, label: str = "label", score: str = "score",
                 n_bins: int = 10) -> DataFrame:
    """Decile report, riskiest first: label, probability range, customers,
    churners, avg score, rate, cumulative churners / gain / customers, lift.
    The window runs over at most ``n_bins`` summary rows."""
    j = binned_histogram(df, label, score, n_bins)
    j = j.withColumn("_lo", F.element_at("edges", F.col("_bin") + 1)).withColumn(
        "_hi", F.element_at("edges", F.col("_bin") + 2))
    g = j.groupBy("_bin").agg(F.sum("n").alias("customers"), F.sum("pos").alias("churners"),
                              (F.sum("_sv") / F.sum("n")).alias("avg_score"),
                              F.first("_lo").alias("lo"), F.first("_hi").alias("hi"))
    w = Window.orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(F.lit(0))
    g = g.select("*",
                 F.sum("churners").over(w).alias("cum_churners"),
                 F.sum("customers").over(w).alias("cum_customers"),
                 F.sum("churners").over(tot).alias("_tc"),
                 F.sum("customers").over(tot).alias("_tn"),
                 F.row_number().over(Window.orderBy(F.col("_bin").desc())).alias("rank"))
    base = _div(F.col("_tc"), F.col("_tn"))
    rate = _div(F.col("churners"), F.col("customers"))
    return g.select(
        F.format_string("%dº Decil", F.col("rank")).alias("decil"),
        F.col("rank").cast("int").alias("rank"),
        F.col("lo").alias("prob_lo"), F.col("hi").alias("prob_hi"),
        F.concat(_percent(F.col("lo")), F.lit("% a "), _percent(F.col("hi")), F.lit("%")).alias("prob_range"),
        "customers", "churners", F.col("avg_score").alias("avg_score"),
        rate.alias("churn_rate"), "cum_churners",
        _div(F.col("cum_churners"), F.when(F.col("_tc") > 0, F.col("_tc")).otherwise(1))
        .alias("cum_gain"),
        F.when(base > 0, rate / base).alias("lift"),
        "cum_customers", _div(F.col("cum_customers"), F.col("_tn")).alias("cum_customers_pct"))


def calibration_curve(df: DataFrame, label: str = "label", score: str = "score",
                      n_bins: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Uniform right-closed bins on [0, 1]: mean score and observed rate;
    empty bins are absent. Inner edges are i * (1 / n_bins)."""
    step = 1.0 / n_bins
    edges = [i * step for i in range(1, n_bins)]
    b = sum((F.col(score) > F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
    return (df.where(valid(df, score)).withColumn("bin", b.cast("int")).groupBy(*by, "bin")
            .agg(F.avg(F.col(label).cast("double")).alias("prob_true"),
                 F.avg(score).alias("prob_pred"), F.count(F.lit(1)).alias("n")))


# ----------------------------------------------------------------- per-row order

def gains_curve(df: DataFrame, id_col: str, label: str = "label", score: str = "score",
                by: Sequence[str] = ()) -> DataFrame:
    """Per row by score desc (ties by md5(id), id): cumulative share of the
    base and of the churners."""
    src = df.where(valid(df, score)).select(*by, id_col, score, F.col(label).cast("long").alias("_y"))
    r = running_rows(src, order=score, id_col=id_col, values=["_y"], by=by)
    r = with_totals(r, r, {"_T": F.count(F.lit(1)), "_C": F.sum("_y")}, by)
    return r.select(*by, id_col, score, "pos", _div(F.col("pos"), F.col("_T")).alias("cum_base"),
                    _div(F.col("cum__y"), F.col("_C")).alias("cum_churn"))


def gain_at_top(df: DataFrame, id_col: str, label: str = "label", score: str = "score",
                p: float = 0.20, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative churn share at row floor(n * p) of the descending order;
    0 when that row index is 0."""
    src = df.select(*by, id_col, score, F.col(label).cast("long").alias("_y"))
    top = top_sums(src, order=score, id_col=id_col, values=["_y"], fractions=[p], by=by)
    return top.select(*by, "k", F.coalesce(_div(F.col("top__y"), F.col("all__y")), F.lit(0.0)).alias("gain"))
