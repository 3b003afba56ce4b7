"""SQL twins of the subscriber view stack, for the DuckDB oracle.

``with_views(body)`` prefixes a statement with the CTE chain
subscribers -> typed -> clean -> features -> model -> scored, written in
ANSI SQL against the base tables.
"""

from __future__ import annotations

from .subscribers import FORMULA_SCORE_SQL, SUBSCRIBERS_SQL

_SERVICES_SUM = " + ".join(
    f"(CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END)"
    for c in ["onlinesecurity", "onlinebackup", "deviceprotection", "techsupport",
              "streamingtv", "streamingmovies"]
)

TYPED_SQL = """
SELECT customerid, gender, seniorcitizen, partner, dependents, tenure, phoneservice, multiplelines,
       internetservice, onlinesecurity, onlinebackup, deviceprotection, techsupport, streamingtv,
       streamingmovies, contract, paperlessbilling, paymentmethod, monthlycharges,
       CAST(NULLIF(trim(totalcharges), '') AS DOUBLE) AS totalcharges, churn
FROM subscribers
"""

CLEAN_SQL = "SELECT * FROM typed WHERE totalcharges IS NOT NULL"

FEATURES_SQL = f"""
SELECT b.*,
       CAST(CASE WHEN paymentmethod LIKE '%automatic%' THEN 1 ELSE 0 END AS INTEGER) AS automatic_payment,
       CASE WHEN total_services > 0 THEN monthlycharges / CAST(total_services AS DOUBLE)
            ELSE monthlycharges END AS avg_charge_per_service,
       CAST(CASE WHEN streamingtv = 'Yes' OR streamingmovies = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS streaming_user,
       CAST(CASE WHEN internetservice <> 'No' AND phoneservice = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS internet_and_phone,
       CASE WHEN tenure <= 6 THEN 'Newbie' WHEN tenure >= 7 AND tenure <= 24 THEN 'Stable'
            ELSE 'Loyal' END AS customer_lifecycle_stage
FROM (SELECT *, CAST({_SERVICES_SUM} AS INTEGER) AS total_services FROM clean) b
"""

MODEL_SQL = """
SELECT customerid, tenure, monthlycharges, totalcharges, total_services, avg_charge_per_service,
       seniorcitizen, automatic_payment, streaming_user, internet_and_phone, customer_lifecycle_stage,
       gender, partner, dependents, phoneservice, multiplelines, internetservice, contract,
       paperlessbilling, paymentmethod, onlinesecurity, onlinebackup, deviceprotection, techsupport,
       streamingtv, streamingmovies,
       CAST(CASE WHEN churn = 'Yes' THEN 1 WHEN churn = 'No' THEN 0 END AS INTEGER) AS target
FROM features WHERE churn IN ('Yes', 'No')
"""

SCORED_SQL = f"SELECT *, {FORMULA_SCORE_SQL} AS score FROM model"

# Line-item score table (heavy ties): label = returned, score in [0, 0.9].
LINE_SCORES_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'
       || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS id,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS label,
       round(l_discount * 5e0 + l_tax * 5e0, 4) AS score,
       l_quantity AS value
FROM lineitem
"""

_CHAIN = [
    ("subscribers", SUBSCRIBERS_SQL),
    ("typed", TYPED_SQL),
    ("clean", CLEAN_SQL),
    ("features", FEATURES_SQL),
    ("model", MODEL_SQL),
    ("scored", SCORED_SQL),
]


def with_views(body: str, *extra: tuple[str, str], lines: bool = False) -> str:
    """Prefix ``body`` with the view chain (and optional extra CTEs)."""
    ctes = list(_CHAIN)
    if lines:
        ctes.append(("line_scores", LINE_SCORES_SQL))
    ctes.extend(extra)
    text = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes)
    return f"WITH {text}\n{body.strip()}"


def with_lines(body: str, *extra: tuple[str, str]) -> str:
    ctes = [("line_scores", LINE_SCORES_SQL), *extra]
    text = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes)
    return f"WITH {text}\n{body.strip()}"
