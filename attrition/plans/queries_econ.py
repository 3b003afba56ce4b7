"""Registered queries: scoring segmentation and economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import economics as eco
from ..operators import scoring as sc
from .base import scored_df
from .catalog import query
from .sql import with_views
from .subscribers import table

T = 0.46
ORDER_SQL = "ORDER BY score DESC, md5(CAST(customerid AS VARCHAR)), customerid"


def _seg_sql(key: str, threshold: bool) -> str:
    where = f" WHERE score >= {T}e0" if threshold else ""
    name = "revenue_at_risk" if threshold else "revenue"
    return with_views(f"SELECT {key}, round(sum(monthlycharges), 6) AS {name}, count(*) AS customers"
                      f" FROM scored{where} GROUP BY {key}")


@query("revenue_by_contract", _seg_sql("contract", False))
def q_revenue_by_contract(spark, sf):
    return eco.revenue_by(scored_df(spark, sf), key="contract")


@query("risk_revenue_by_security", _seg_sql("onlinesecurity", True))
def q_risk_revenue_by_security(spark, sf):
    return eco.revenue_by(scored_df(spark, sf), key="onlinesecurity", score="score", threshold=T)


@query("risk_revenue_by_support", _seg_sql("techsupport", True))
def q_risk_revenue_by_support(spark, sf):
    return eco.revenue_by(scored_df(spark, sf), key="techsupport", score="score", threshold=T)


@query("risk_revenue_share", with_views(f"""
SELECT techsupport, revenue_at_risk, customers,
       round(revenue_at_risk / sum(revenue_at_risk) OVER () * 100, 6) AS percent
FROM (SELECT techsupport, round(sum(monthlycharges), 6) AS revenue_at_risk, count(*) AS customers
      FROM scored WHERE score >= {T}e0 GROUP BY techsupport)"""))
def q_risk_revenue_share(spark, sf):
    return eco.risk_revenue_share(scored_df(spark, sf), key="techsupport", threshold=T)


@query("risk_waterfall", with_views(f"""
SELECT step, round(amount, 6) AS amount,
       CAST(row_number() OVER (ORDER BY amount DESC, step) AS INTEGER) AS sort_key,
       round(sum(amount) OVER (ORDER BY amount DESC, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
         AS running
FROM g
UNION ALL SELECT 'Total', round(sum(amount), 6), CAST(count(*) + 1 AS INTEGER), round(sum(amount), 6) FROM g""",
    ("g", f"SELECT CAST(onlinesecurity AS VARCHAR) AS step, round(sum(monthlycharges), 6) AS amount"
          f" FROM scored WHERE score >= {T}e0 GROUP BY onlinesecurity")))
def q_risk_waterfall(spark, sf):
    return eco.risk_waterfall(scored_df(spark, sf), key="onlinesecurity", threshold=T)


@query("executive_kpis", with_views(f"""
SELECT customers, round(churn_rate, 6) AS churn_rate, customers_at_risk,
       round(rev, 6) AS revenue_at_risk_month, round(rev * 12e0, 6) AS revenue_at_risk_year,
       round(rev * 6e0 * 0.3e0, 6) AS potential_saved, round(customers_at_risk * 50e0, 6) AS campaign_cost,
       round((rev * 6e0 * 0.3e0 - customers_at_risk * 50e0) / NULLIF(customers_at_risk * 50e0, 0), 6) AS roi
FROM (SELECT count(*) AS customers, avg(target) AS churn_rate,
             count(*) FILTER (WHERE score >= {T}e0) AS customers_at_risk,
             coalesce(sum(monthlycharges) FILTER (WHERE score >= {T}e0), 0e0) AS rev FROM scored)"""))
def q_executive_kpis(spark, sf):
    return eco.executive_kpis(scored_df(spark, sf), threshold=T)


@query("campaign_roi", with_views(f"""
SELECT customers_at_risk, round(rev, 6) AS revenue_at_risk, round(rev * 6e0 * 0.3e0, 6) AS saved,
       round(customers_at_risk * 50e0, 6) AS cost,
       round((rev * 6e0 * 0.3e0 - customers_at_risk * 50e0) / NULLIF(customers_at_risk * 50e0, 0), 6) AS roi,
       round((rev * 6e0 * 0.3e0 - customers_at_risk * 50e0) / NULLIF(customers_at_risk * 50e0, 0) * 100, 6)
         AS roi_pct
FROM (SELECT count(*) AS customers_at_risk, coalesce(sum(monthlycharges), 0e0) AS rev
      FROM scored WHERE score >= {T}e0)"""))
def q_campaign_roi(spark, sf):
    return eco.campaign_roi(scored_df(spark, sf), threshold=T)


@query("priority_curve", with_views(f"""
SELECT customerid, score, row_number() OVER ({ORDER_SQL}) AS pos,
       round(row_number() OVER ({ORDER_SQL}) / count(*) OVER (), 6) AS cum_clients_pct,
       round(sum(monthlycharges) OVER ({ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(monthlycharges) OVER (), 6) AS cum_revenue_pct
FROM scored"""))
def q_priority_curve(spark, sf):
    return eco.priority_curve(scored_df(spark, sf), id_col="customerid")


@query("roi_by_depth", with_views("""
SELECT pct_clients, clients, round(saved, 6) AS saved, round(cost, 6) AS cost,
       round((saved - cost) / NULLIF(cost, 0), 6) AS roi
FROM (SELECT CAST(pct AS INTEGER) AS pct_clients, CAST(floor(max(n) * p) AS BIGINT) AS clients,
             coalesce(sum(v) FILTER (WHERE pos <= floor(n * p)), 0e0) * 6e0 * 0.3e0 AS saved,
             CAST(floor(max(n) * p) AS BIGINT) * 50e0 AS cost
      FROM d, r GROUP BY pct, p)""",
    ("r", f"SELECT monthlycharges AS v, row_number() OVER ({ORDER_SQL}) AS pos, count(*) OVER () AS n FROM scored"),
    ("d", "SELECT * FROM (VALUES (10, 0.1e0), (20, 0.2e0), (30, 0.3e0), (40, 0.4e0), (50, 0.5e0)) t(pct, p)")))
def q_roi_by_depth(spark, sf):
    return eco.roi_by_depth(scored_df(spark, sf), id_col="customerid")


_SLIDER_VALUES = ", ".join(f"({t!r}e0)" for t in eco.slider())
_COUNTS_CTE = ("tc", f"""
SELECT t.threshold, count(s.score) AS contacted, CAST(coalesce(sum(s.target), 0) AS BIGINT) AS tp
FROM (SELECT * FROM (VALUES {_SLIDER_VALUES}) v(threshold)) t
LEFT JOIN scored s ON s.score >= t.threshold GROUP BY t.threshold""")


@query("threshold_simulation", with_views("""
SELECT threshold, contacted, tp, round(ret, 6) AS retained, round(ben, 6) AS benefit, round(cost, 6) AS cost,
       round(ben - cost, 6) AS profit, round(roi, 6) AS roi, CAST(ben - cost < 0 AS INTEGER) AS loss,
       round(roi + 1, 6) AS return_per_unit
FROM (SELECT *, CASE WHEN cost > 0 THEN (ben - cost) / cost ELSE 0e0 END AS roi
      FROM (SELECT threshold, contacted, tp, tp * 0.25e0 AS ret, tp * 0.25e0 * 300e0 AS ben,
                   contacted * 5e0 + tp * 0.25e0 * 50e0 AS cost FROM tc))""", _COUNTS_CTE))
def q_threshold_simulation(spark, sf):
    return eco.threshold_simulation(scored_df(spark, sf))


@query("strategy_efficiency", with_views("""
SELECT threshold, round(b, 6) AS pct_base_contacted, round(c, 6) AS pct_churn_captured,
       round(c / NULLIF(b, 0), 6) AS efficiency
FROM (SELECT threshold, contacted / (SELECT count(*) FROM scored) AS b,
             tp / (SELECT sum(target) FROM scored) AS c FROM tc)""", _COUNTS_CTE))
def q_strategy_efficiency(spark, sf):
    return eco.strategy_efficiency(scored_df(spark, sf))


@query("impact_projection", with_views("""
SELECT contract, count(*) AS base, round(avg(target), 6) AS churn_rate, round(avg(monthlycharges), 6) AS ticket,
       round(count(*) * avg(target) * avg(monthlycharges) * 12e0, 4) AS annual_at_risk,
       round(count(*) * avg(target) * avg(monthlycharges) * 12e0 * 0.3e0, 4) AS saved
FROM scored GROUP BY contract"""), places={"annual_at_risk": 4, "saved": 4})
def q_impact_projection(spark, sf):
    return eco.impact_projection(scored_df(spark, sf), segment="contract")


@query("segment_alert", with_views("""
SELECT contract, round(avg(target), 6) AS churn_rate, count(*) AS customers
FROM scored GROUP BY contract HAVING avg(target) > 0.25e0"""))
def q_segment_alert(spark, sf):
    return eco.segment_alert(scored_df(spark, sf), segment="contract", limit=0.25)


@query("revenue_risk_change", with_views("""
SELECT m.month, round(m.amount, 2) AS amount,
       round((m.amount - p.amount) / NULLIF(p.amount, 0), 6) AS change
FROM mo m LEFT JOIN mo p ON p.month = CAST(m.month - INTERVAL 1 MONTH AS DATE)""", ("mo", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN scored ON customerid = c_name
WHERE o_orderstatus = 'P' AND score >= 0.46e0 GROUP BY 1""")), places={"amount": 2})
def q_revenue_risk_change(spark, sf):
    """Monthly order revenue of the customers at risk."""
    at_risk = scored_df(spark, sf).where(F.col("score") >= 0.46).select(F.col("customerid").alias("c_name"))
    keys = table(spark, sf, "customer").select("c_name", F.col("c_custkey").alias("o_custkey")).join(
        at_risk, "c_name")
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").join(keys, "o_custkey", "left_semi")
    return eco.revenue_risk_change(o, time_col="o_orderdate", amount="o_totalprice")


# ---------------------------------------------------------------- segmentation

@query("risk_band", with_views("""
SELECT customerid, score,
       CASE WHEN score >= 0.7e0 THEN 'Alto' WHEN score >= 0.4e0 THEN 'Médio' ELSE 'Baixo' END AS risk_band,
       CASE WHEN score >= 0.7e0 THEN 'Ofertar retenção imediata (desconto/upgrade + contato ativo)'
            WHEN score >= 0.4e0 THEN 'Campanha direcionada (benefícios + onboarding de serviços)'
            ELSE 'Manter relacionamento (NPS, melhorias e cross-sell leve)' END AS action
FROM scored"""))
def q_risk_band(spark, sf):
    return sc.risk_band(scored_df(spark, sf)).select("customerid", "score", "risk_band", "action")


_CUT_SQL = """CASE WHEN score > 0e0 AND score <= 0.3e0 THEN 'Baixo'
            WHEN score > 0.3e0 AND score <= 0.6e0 THEN 'Médio'
            WHEN score > 0.6e0 AND score <= 1e0 THEN 'Alto' END"""


@query("risk_level_cut", with_views(f"SELECT customerid, score, {_CUT_SQL} AS risk_level FROM scored"))
def q_risk_level_cut(spark, sf):
    return sc.risk_level_cut(scored_df(spark, sf)).select("customerid", "score", "risk_level")


@query("risk_level_counts", with_views(f"""
SELECT l.risk_level, l.sort_key, coalesce(c.n, 0) AS count,
       round(coalesce(c.n, 0) * 100e0 / NULLIF(sum(coalesce(c.n, 0)) OVER (), 0), 6) AS percent
FROM (SELECT * FROM (VALUES ('Baixo', 0), ('Médio', 1), ('Alto', 2)) v(risk_level, sort_key)) l
LEFT JOIN (SELECT {_CUT_SQL} AS risk_level, count(*) AS n FROM scored GROUP BY 1) c
  ON l.risk_level = c.risk_level"""))
def q_risk_level_counts(spark, sf):
    return sc.risk_level_counts(scored_df(spark, sf))


@query("priority_tier", with_views(f"""
SELECT customerid, score, pos,
       CASE WHEN pos <= floor(n * 0.1e0) THEN 'immediate' WHEN pos <= floor(n * 0.2e0) THEN 'campaign'
            ELSE 'monitor' END AS priority
FROM (SELECT customerid, score, row_number() OVER ({ORDER_SQL}) AS pos, count(*) OVER () AS n FROM scored)"""))
def q_priority_tier(spark, sf):
    d = scored_df(spark, sf).select("customerid", "score")
    return sc.priority_tier(d, id_col="customerid").select("customerid", "score", "pos", "priority")
