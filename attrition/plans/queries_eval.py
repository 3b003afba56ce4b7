"""Registered queries: evaluation of a score table.

Three score tables: the formula-scored subscribers (``ev``) and every line
item with a heavily tied score (``lines``), which exercises the hot-tie
paths of the running-sum primitive, and every line item with an unrounded margin
(``hc``), which exercises its buckets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from .base import line_scores, scored_df
from .catalog import query
from .sql import with_lines, with_views
from .subscribers import table

THRESHOLD = 0.46


def ev_input(spark, sf):
    return scored_df(spark, sf).select(
        F.col("customerid").alias("id"), F.col("target").alias("label"), "score",
        F.col("monthlycharges").alias("value"))


EV_CTE = ("ev", "SELECT customerid AS id, target AS label, score, monthlycharges AS value FROM scored")


def curve_ctes(src: str) -> list[tuple[str, str]]:
    return [
        ("h", f"SELECT score AS threshold, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos,"
              f" count(*) - CAST(sum(label) AS BIGINT) AS neg FROM {src} GROUP BY score"),
        ("c", "SELECT threshold, n, pos, neg,"
              " CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp,"
              " CAST(sum(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp,"
              " CAST(sum(pos) OVER () AS BIGINT) AS tot_pos,"
              " CAST(sum(neg) OVER () AS BIGINT) AS tot_neg FROM h"),
    ]


def sv(body: str, *extra) -> str:
    """Subscriber score table + curve CTEs."""
    return with_views(body, EV_CTE, *curve_ctes("ev"), *extra)


def sl(body: str, *extra) -> str:
    """Line-item score table + curve CTEs."""
    return with_lines(body, ("ev", "SELECT * FROM line_scores"), *curve_ctes("ev"), *extra)


ROC_SQL = """
SELECT threshold, round(fp / NULLIF(tot_neg, 0), 6) AS fpr, round(tp / NULLIF(tot_pos, 0), 6) AS tpr FROM c
UNION ALL SELECT CAST('inf' AS DOUBLE), 0e0, 0e0"""

AUC_SQL = """
SELECT round(sum(pos * ((tot_neg - fp) + neg / 2e0))
             / NULLIF(CAST(max(tot_pos) AS DOUBLE) * CAST(max(tot_neg) AS DOUBLE), 0), 6) AS auc FROM c"""

PR_SQL = """
SELECT threshold, round(tp / NULLIF(tp + fp, 0), 6) AS precision,
       round(CASE WHEN tot_pos = 0 THEN 1e0 ELSE tp / tot_pos END, 6) AS recall FROM c
UNION ALL SELECT CAST(NULL AS DOUBLE), 1e0, 0e0"""

AP_SQL = """
SELECT round(sum(pos * (tp / NULLIF(tp + fp, 0))) / NULLIF(max(tot_pos), 0), 6) AS average_precision FROM c"""

KS_SQL = """
SELECT round(greatest(max(gap), 0e0), 6) AS ks,
       CASE WHEN max(gap) > 0 THEN max(threshold) FILTER (WHERE gap = (SELECT max(gap) FROM g))
            ELSE CAST('inf' AS DOUBLE) END AS ks_threshold
FROM g"""
KS_G = ("g", "SELECT threshold, tp / NULLIF(tot_pos, 0) - fp / NULLIF(tot_neg, 0) AS gap FROM c")

KS_ABS_SQL = """
SELECT CASE WHEN max(tp_) > 0 AND max(tn_) > 0 THEN round(max(d), 6) END AS ks,
       CASE WHEN max(tp_) > 0 AND max(tn_) > 0
            THEN min(s) FILTER (WHERE d = (SELECT max(d) FROM d)) END AS ks_at
FROM d"""
KS_ABS_CTES = [
    ("a", "SELECT threshold AS s, sum(pos) OVER (ORDER BY threshold) AS cp,"
          " sum(neg) OVER (ORDER BY threshold) AS cn, sum(pos) OVER () AS tp_, sum(neg) OVER () AS tn_ FROM h"),
    ("d", "SELECT s, abs(cp / NULLIF(tp_, 0) - cn / NULLIF(tn_, 0)) AS d, tp_, tn_ FROM a"),
]

THR_SQL = """
SELECT coalesce(max(threshold) FILTER (WHERE tp / NULLIF(tot_pos, 0) >= 0.8e0), 0e0) AS threshold FROM c"""

PRED_CTE = ("p", f"SELECT id, label, score, CAST(score >= {THRESHOLD}e0 AS INTEGER) AS pred FROM ev")
COUNTS_CTE = ("k", "SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn,"
                   " count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,"
                   " count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn,"
                   " count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM p")

CONFUSION_SQL = """
SELECT * FROM (
  SELECT 0 AS actual, 0 AS predicted, tn AS n FROM k UNION ALL SELECT 0, 1, fp FROM k
  UNION ALL SELECT 1, 0, fn FROM k UNION ALL SELECT 1, 1, tp FROM k)"""

CONFUSION_NORM_SQL = """
SELECT * FROM (
  SELECT 0 AS actual, 0 AS predicted, round(tn / NULLIF(tn + fp, 0), 6) AS share FROM k
  UNION ALL SELECT 0, 1, round(fp / NULLIF(tn + fp, 0), 6) FROM k
  UNION ALL SELECT 1, 0, round(fn / NULLIF(fn + tp, 0), 6) FROM k
  UNION ALL SELECT 1, 1, round(tp / NULLIF(fn + tp, 0), 6) FROM k)"""

PR_AT_SQL = f"""
SELECT {THRESHOLD}e0 AS threshold, round(coalesce(tp / NULLIF(tp + fp, 0), 0e0), 6) AS precision,
       round(coalesce(tp / NULLIF(tp + fn, 0), 0e0), 6) AS recall, tp, fp, fn, tn FROM k"""

REPORT_SQL = """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM m
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m
  UNION ALL SELECT 'weighted avg', p0 * w0 + p1 * w1, r0 * w0 + r1 * w1, f0 * w0 + f1 * w1, n FROM m)"""
REPORT_CTES = [
    ("m0", "SELECT coalesce(tn / NULLIF(tn + fn, 0), 0e0) AS p0, coalesce(tn / NULLIF(tn + fp, 0), 0e0) AS r0,"
           " coalesce(tp / NULLIF(tp + fp, 0), 0e0) AS p1, coalesce(tp / NULLIF(tp + fn, 0), 0e0) AS r1,"
           " tn + fp AS s0, tp + fn AS s1, tn + fp + tp + fn AS n,"
           " coalesce((tp + tn) / NULLIF(tn + fp + tp + fn, 0), 0e0) AS acc FROM k"),
    ("m", "SELECT *, coalesce(2 * p0 * r0 / NULLIF(p0 + r0, 0), 0e0) AS f0,"
          " coalesce(2 * p1 * r1 / NULLIF(p1 + r1, 0), 0e0) AS f1,"
          " coalesce(s0 / NULLIF(n, 0), 0e0) AS w0, coalesce(s1 / NULLIF(n, 0), 0e0) AS w1 FROM m0"),
]

BALANCE_SQL = """
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM x
WHERE nsg IS NOT NULL AND nsg <> sg ORDER BY i LIMIT 1"""
BALANCE_CTES = [
    ("pts", "SELECT threshold, tp / NULLIF(tp + fp, 0) AS precision,"
            " CASE WHEN tot_pos = 0 THEN 1e0 ELSE tp / tot_pos END AS recall FROM c"
            " UNION ALL SELECT CAST(NULL AS DOUBLE), 1e0, 0e0"),
    ("o", "SELECT *, sign(coalesce(precision, 0e0) - recall) AS sg,"
          " row_number() OVER (ORDER BY threshold NULLS LAST) AS i FROM pts"),
    ("x", "SELECT *, lead(sg) OVER (ORDER BY i) AS nsg FROM o"),
]

PROBS10 = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


def lift_ctes(strict: bool) -> list[tuple[str, str]]:
    return [
        ("e", f"SELECT list_sort(list_distinct(quantile_cont(score, {PROBS10}))) AS edges FROM ev"),
        ("b", "SELECT label, score, len(list_filter(edges[2:len(edges) - 1], lambda x: x < score)) AS bin"
              " FROM ev, e"),
        ("t", "SELECT bin, count(*) AS total, CAST(sum(label) AS BIGINT) AS churn FROM b GROUP BY bin"),
        ("z", "SELECT sum(churn) / sum(total) AS base, max(bin) AS mb FROM t"),
    ]


LIFT_SQL = """
SELECT CAST(mb - bin AS INTEGER) AS decil, total, churn, round(churn / total, 6) AS churn_rate,
       round((churn / total) / (CASE WHEN base > 0 THEN base ELSE 1e-9 END), 6) AS lift,
       round(base, 6) AS baseline FROM t, z"""

LIFT_STRICT_SQL = LIFT_SQL.replace("CAST(mb - bin AS INTEGER)", "CAST(9 - bin AS INTEGER)")

DECILE_SQL = """
SELECT CAST(rk AS VARCHAR) || 'º Decil' AS decil, CAST(rk AS INTEGER) AS rank,
       round(lo, 6) AS prob_lo, round(hi, 6) AS prob_hi,
       (CAST(round(lo * 1000) AS BIGINT) // 10) || '.' || (CAST(round(lo * 1000) AS BIGINT) % 10) || '% a '
       || (CAST(round(hi * 1000) AS BIGINT) // 10) || '.' || (CAST(round(hi * 1000) AS BIGINT) % 10) || '%' AS prob_range,
       customers, churners,
       round(avg_score, 6) AS avg_score, round(churners / customers, 6) AS churn_rate,
       cum_churners,
       round(cum_churners / (CASE WHEN tc > 0 THEN tc ELSE 1 END), 6) AS cum_gain,
       round(CASE WHEN tc / tn > 0 THEN (churners / customers) / (tc / tn) END, 6) AS lift,
       cum_customers, round(cum_customers / tn, 6) AS cum_customers_pct
FROM (
  SELECT g.*, row_number() OVER (ORDER BY bin DESC) AS rk,
         CAST(sum(churners) OVER (ORDER BY bin DESC) AS BIGINT) AS cum_churners,
         CAST(sum(customers) OVER (ORDER BY bin DESC) AS BIGINT) AS cum_customers,
         sum(churners) OVER () AS tc, sum(customers) OVER () AS tn
  FROM (SELECT bin, count(*) AS customers, CAST(sum(label) AS BIGINT) AS churners,
               avg(score) AS avg_score, min(edges[bin + 1]) AS lo, min(edges[bin + 2]) AS hi
        FROM (SELECT b.*, e.edges FROM b, e) GROUP BY bin) g)"""

GAINS_SQL = """
SELECT id, score, row_number() OVER w AS pos,
       round(row_number() OVER w / count(*) OVER (), 6) AS cum_base,
       round(sum(label) OVER (ORDER BY score DESC, md5(CAST(id AS VARCHAR)), id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(label) OVER (), 6) AS cum_churn
FROM ev WINDOW w AS (ORDER BY score DESC, md5(CAST(id AS VARCHAR)), id)"""

GAIN_TOP_SQL = """
SELECT CAST(floor(count(*) * 0.2e0) AS BIGINT) AS k,
       round(coalesce(sum(label) FILTER (WHERE pos <= (SELECT floor(count(*) * 0.2e0) FROM ev))
                      / NULLIF(sum(label), 0), 0e0), 6) AS gain
FROM (SELECT label, row_number() OVER (ORDER BY score DESC, md5(CAST(id AS VARCHAR)), id) AS pos FROM ev)"""

_EDGES5 = [i * (1.0 / 5) for i in range(1, 5)]
CALIB_SQL = (
    "SELECT CAST(" + " + ".join(f"(CASE WHEN score > {repr(e)}e0 THEN 1 ELSE 0 END)"
                                if "e" not in repr(e) else f"(CASE WHEN score > {repr(e)} THEN 1 ELSE 0 END)"
                                for e in _EDGES5)
    + " AS INTEGER) AS bin, round(avg(label), 6) AS prob_true, round(avg(score), 6) AS prob_pred,"
      " count(*) AS n FROM ev GROUP BY 1")


# ---------------------------------------------------------------- subscribers

@query("score_histogram", sv("SELECT threshold AS score, n, pos, neg, tp, fp FROM c"))
def q_score_histogram(spark, sf):
    return ev.score_histogram_table(ev_input(spark, sf))


@query("roc_curve", sv(ROC_SQL))
def q_roc_curve(spark, sf):
    return ev.roc_curve(ev_input(spark, sf))


@query("roc_auc", sv(AUC_SQL))
def q_roc_auc(spark, sf):
    return ev.roc_auc(ev_input(spark, sf))


@query("roc_from_labels", with_views(
    ROC_SQL, EV_CTE,
    ("ev2", "SELECT id, label, CAST(CAST(score > 0.5e0 AS INTEGER) AS DOUBLE) AS score FROM ev"),
    *curve_ctes("ev2")))
def q_roc_from_labels(spark, sf):
    d = ev.apply_threshold(ev_input(spark, sf), "score", 0.5, out="pred", strict=True)
    return ev.roc_curve(d.withColumn("score", F.col("pred").cast("double")))


@query("pr_curve", sv(PR_SQL))
def q_pr_curve(spark, sf):
    return ev.pr_curve(ev_input(spark, sf))


@query("average_precision", sv(AP_SQL))
def q_average_precision(spark, sf):
    return ev.average_precision(ev_input(spark, sf))


@query("ks_signed", sv(KS_SQL, KS_G))
def q_ks_signed(spark, sf):
    return ev.ks_signed(ev_input(spark, sf))


@query("ks_curve", sv("""
SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(tpr - fpr, 6) AS gap
FROM (SELECT threshold, fp / NULLIF(tot_neg, 0) AS fpr, tp / NULLIF(tot_pos, 0) AS tpr FROM c
      UNION ALL SELECT CAST('inf' AS DOUBLE), 0e0, 0e0)"""))
def q_ks_curve(spark, sf):
    return ev.ks_curve(ev_input(spark, sf))


@query("ks_abs", sv(KS_ABS_SQL, *KS_ABS_CTES))
def q_ks_abs(spark, sf):
    return ev.ks_abs(ev_input(spark, sf))


@query("threshold_min_recall", sv(THR_SQL))
def q_threshold_min_recall(spark, sf):
    return ev.threshold_min_recall(ev_input(spark, sf), min_recall=0.8)


@query("apply_threshold", sv("SELECT id, score, pred FROM p", PRED_CTE))
def q_apply_threshold(spark, sf):
    return ev.apply_threshold(ev_input(spark, sf), "score", THRESHOLD).select("id", "score", "pred")


@query("confusion_matrix", sv(CONFUSION_SQL, PRED_CTE, COUNTS_CTE))
def q_confusion_matrix(spark, sf):
    return ev.confusion_matrix(ev.apply_threshold(ev_input(spark, sf), "score", THRESHOLD))


@query("confusion_normalized", sv(CONFUSION_NORM_SQL, PRED_CTE, COUNTS_CTE))
def q_confusion_normalized(spark, sf):
    return ev.confusion_normalized(ev.apply_threshold(ev_input(spark, sf), "score", THRESHOLD))


@query("precision_recall_at", sv(PR_AT_SQL, PRED_CTE, COUNTS_CTE))
def q_precision_recall_at(spark, sf):
    return ev.precision_recall_at(ev_input(spark, sf), threshold=THRESHOLD)


@query("classification_report", sv(REPORT_SQL, PRED_CTE, COUNTS_CTE, *REPORT_CTES))
def q_classification_report(spark, sf):
    return ev.classification_report(ev.apply_threshold(ev_input(spark, sf), "score", THRESHOLD))


@query("pr_balance_point", sv(BALANCE_SQL, *BALANCE_CTES))
def q_pr_balance_point(spark, sf):
    return ev.pr_balance_point(ev_input(spark, sf))


@query("lift_deciles", sv(LIFT_SQL, *lift_ctes(False)))
def q_lift_deciles(spark, sf):
    return ev.lift_deciles(ev_input(spark, sf))


@query("lift_deciles_strict", sv(LIFT_STRICT_SQL, *lift_ctes(True)))
def q_lift_deciles_strict(spark, sf):
    return ev.lift_deciles(ev_input(spark, sf), strict=True)


@query("decile_table", sv(DECILE_SQL, *lift_ctes(False)))
def q_decile_table(spark, sf):
    return ev.decile_table(ev_input(spark, sf))


@query("gains_curve", sv(GAINS_SQL))
def q_gains_curve(spark, sf):
    return ev.gains_curve(ev_input(spark, sf), id_col="id")


@query("gain_at_top", sv(GAIN_TOP_SQL))
def q_gain_at_top(spark, sf):
    return ev.gain_at_top(ev_input(spark, sf), id_col="id", p=0.2)


@query("calibration_curve", sv(CALIB_SQL))
def q_calibration_curve(spark, sf):
    return ev.calibration_curve(ev_input(spark, sf), n_bins=5)


# ---------------------------------------------------------------- line items (hot ties)

@query("lines_roc_auc", sl(AUC_SQL))
def q_lines_roc_auc(spark, sf):
    return ev.roc_auc(line_scores(spark, sf))


@query("lines_ks_signed", sl(KS_SQL, KS_G))
def q_lines_ks_signed(spark, sf):
    return ev.ks_signed(line_scores(spark, sf))


@query("lines_lift_deciles", sl(LIFT_SQL, *lift_ctes(False)))
def q_lines_lift_deciles(spark, sf):
    return ev.lift_deciles(line_scores(spark, sf))


@query("lines_gains_curve", sl(GAINS_SQL))
def q_lines_gains_curve(spark, sf):
    return ev.gains_curve(line_scores(spark, sf), id_col="id")


@query("lines_gain_at_top", sl(GAIN_TOP_SQL))
def q_lines_gain_at_top(spark, sf):
    return ev.gain_at_top(line_scores(spark, sf), id_col="id", p=0.2)


@query("lines_average_precision", sl(AP_SQL))
def q_lines_average_precision(spark, sf):
    return ev.average_precision(line_scores(spark, sf))


# ---------------------------------------------------------------- line items, nearly all scores different

# A margin rather than a probability: unrounded, below 0 and above 1, many rows in a bucket.
HC_SQL = ("SELECT id, label, l_extendedprice * (1e0 - l_discount) * (1e0 + l_tax) / 40000e0 - 0.25e0 AS score, value"
          " FROM (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'"
          " || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS id,"
          " CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS label, l_quantity AS value"
          " FROM lineitem)")


def sh(body: str, *extra) -> str:
    return with_lines(body, ("ev", HC_SQL), *curve_ctes("ev"), *extra)


def hc_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("label"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) * (F.lit(1.0) + F.col("l_tax"))
         / F.lit(40000.0) - F.lit(0.25)).alias("score"), F.col("l_quantity").alias("value"))


@query("hc_roc_auc", sh(AUC_SQL))
def q_hc_roc_auc(spark, sf):
    return ev.roc_auc(hc_scores(spark, sf))


@query("hc_ks_signed", sh(KS_SQL, KS_G))
def q_hc_ks_signed(spark, sf):
    return ev.ks_signed(hc_scores(spark, sf))


@query("hc_lift_deciles", sh(LIFT_SQL, *lift_ctes(False)))
def q_hc_lift_deciles(spark, sf):
    return ev.lift_deciles(hc_scores(spark, sf))


@query("hc_gains_curve", sh(GAINS_SQL))
def q_hc_gains_curve(spark, sf):
    return ev.gains_curve(hc_scores(spark, sf), id_col="id")
