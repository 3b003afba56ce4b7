"""Registered queries: sources, cleaning, features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import clean
from ..operators.evaluate import threshold_min_recall
from ..schemas import RAW, SERVICE_COLUMNS_FORM
from ..session import scratch_path
from ..sources import io
from .base import model_df, scored_df
from .catalog import query
from .sql import with_views
from .subscribers import subscribers


@query("raw_schema", with_views("SELECT * FROM subscribers"))
def q_raw_schema(spark, sf):
    """The raw table, written and read with its declared schema."""
    path = scratch_path(spark, f"raw-{uuid.uuid4().hex[:12]}")
    io.write_table(clean.align_to_schema(subscribers(spark, sf), RAW), path)
    return io.read_raw(spark, path)


@query("typed_view", with_views("SELECT * FROM typed"))
def q_typed_view(spark, sf):
    return clean.typed_view(subscribers(spark, sf))


@query("clean_view", with_views("SELECT * FROM clean"))
def q_clean_view(spark, sf):
    return clean.clean_view(clean.typed_view(subscribers(spark, sf)))


@query("labelled_only", with_views(
    "SELECT customerid, churn FROM subscribers WHERE churn IN ('Yes', 'No')"))
def q_labelled_only(spark, sf):
    return clean.labelled_only(subscribers(spark, sf)).select("customerid", "churn")


@query("encode_target", with_views(
    "SELECT customerid, churn, CAST(CASE WHEN churn = 'Yes' THEN 1 WHEN churn = 'No' THEN 0 END AS INTEGER)"
    " AS target FROM subscribers"))
def q_encode_target(spark, sf):
    return clean.encode_target(subscribers(spark, sf)).select("customerid", "churn", "target")


@query("feature_view", with_views("SELECT * FROM features"))
def q_feature_view(spark, sf):
    return clean.feature_view(clean.clean_view(clean.typed_view(subscribers(spark, sf))))


@query("model_view", with_views("SELECT * FROM model"))
def q_model_view(spark, sf):
    return model_df(spark, sf)


@query("risk_revenue_by_contract", with_views("""
SELECT contract, round(sum(monthlycharges), 6) AS revenue_at_risk, count(*) AS customers
FROM scored WHERE score >= 0.46e0 GROUP BY contract"""))
def q_risk_revenue_by_contract(spark, sf):
    from ..operators.economics import revenue_by
    return revenue_by(scored_df(spark, sf), key="contract", score="score", threshold=0.46)


# ---------------------------------------------------------------- per-row features (§2.3)

def _clean(spark, sf):
    return clean.clean_view(clean.typed_view(subscribers(spark, sf)))


_SERV6 = ("(CASE WHEN onlinesecurity = 'Yes' THEN 1 ELSE 0 END) + (CASE WHEN onlinebackup = 'Yes' THEN 1 ELSE 0 END)"
          " + (CASE WHEN deviceprotection = 'Yes' THEN 1 ELSE 0 END) + (CASE WHEN techsupport = 'Yes' THEN 1 ELSE 0 END)"
          " + (CASE WHEN streamingtv = 'Yes' THEN 1 ELSE 0 END) + (CASE WHEN streamingmovies = 'Yes' THEN 1 ELSE 0 END)")
_SERV7 = _SERV6 + " + (CASE WHEN phoneservice = 'Yes' THEN 1 ELSE 0 END)"


@query("total_services", with_views(f"SELECT customerid, CAST({_SERV6} AS INTEGER) AS total_services FROM clean"))
def q_total_services(spark, sf):
    return _clean(spark, sf).select("customerid", fx.total_services().alias("total_services"))


@query("total_services_form", with_views(
    f"SELECT customerid, CAST({_SERV7} AS INTEGER) AS total_services FROM clean"))
def q_total_services_form(spark, sf):
    return _clean(spark, sf).select("customerid",
                                    fx.total_services(SERVICE_COLUMNS_FORM).alias("total_services"))


@query("automatic_payment", with_views(
    "SELECT customerid, CAST(CASE WHEN paymentmethod LIKE '%automatic%' THEN 1 ELSE 0 END AS INTEGER)"
    " AS automatic_payment FROM clean"))
def q_automatic_payment(spark, sf):
    return _clean(spark, sf).select("customerid", fx.automatic_payment().alias("automatic_payment"))


@query("automatic_payment_form", with_views(
    "SELECT customerid, CAST(CASE WHEN paymentmethod IN ('Bank transfer (automatic)', 'Credit card (automatic)')"
    " THEN 1 ELSE 0 END AS INTEGER) AS automatic_payment FROM clean"))
def q_automatic_payment_form(spark, sf):
    return _clean(spark, sf).select("customerid", fx.automatic_payment_form().alias("automatic_payment"))


@query("avg_charge_per_service", with_views(
    "SELECT customerid, avg_charge_per_service FROM features"))
def q_avg_charge_per_service(spark, sf):
    return _clean(spark, sf).select(
        "customerid", fx.avg_charge_per_service(services=fx.total_services()).alias("avg_charge_per_service"))


@query("streaming_user", with_views("SELECT customerid, streaming_user FROM features"))
def q_streaming_user(spark, sf):
    return _clean(spark, sf).select("customerid", fx.streaming_user().alias("streaming_user"))


@query("internet_and_phone", with_views("SELECT customerid, internet_and_phone FROM features"))
def q_internet_and_phone(spark, sf):
    return _clean(spark, sf).select("customerid", fx.internet_and_phone().alias("internet_and_phone"))


@query("lifecycle_stage", with_views("SELECT customerid, customer_lifecycle_stage FROM features"))
def q_lifecycle_stage(spark, sf):
    return _clean(spark, sf).select("customerid", fx.lifecycle_stage().alias("customer_lifecycle_stage"))


# ---------------------------------------------------------------- projection helpers (§2.2)

@query("drop_columns", with_views(
    "SELECT * EXCLUDE (customerid) FROM model"))
def q_drop_columns(spark, sf):
    return clean.drop_columns(model_df(spark, sf), ["customerid"], ["not_a_column"], [])


@query("align_to_schema", with_views(
    "SELECT customerid, tenure, monthlycharges, CAST(NULL AS VARCHAR) AS extra_missing FROM model"))
def q_align_to_schema(spark, sf):
    from pyspark.sql import types as T
    target = T.StructType([T.StructField("customerid", T.StringType()),
                           T.StructField("tenure", T.IntegerType()),
                           T.StructField("monthlycharges", T.DoubleType()),
                           T.StructField("extra_missing", T.StringType())])
    return clean.align_to_schema(model_df(spark, sf), target)


def _inverse_case(col: str) -> str:
    m = clean.FORM_CODE_MAPS[col]
    whens = " ".join(f"WHEN {col} = '{v}' THEN '{k}'" for k, v in m.items())
    return f"CASE {whens} END"


def _forward_case(expr: str, col: str) -> str:
    m = clean.FORM_CODE_MAPS[col]
    whens = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in m.items())
    return f"CASE {whens} END"


def _map_codes_sql() -> str:
    cols = list(clean.FORM_CODE_MAPS)
    inv = ", ".join(f"{_inverse_case(c)} AS {c}_form" for c in cols)
    fwd = ", ".join(f"{_forward_case(c + '_form', c)} AS {c}_code" for c in cols)
    return with_views(f"SELECT customerid, {', '.join(c + '_form' for c in cols)}, {fwd}"
                      f" FROM (SELECT customerid, {inv} FROM model)")


@query("map_codes", _map_codes_sql())
def q_map_codes(spark, sf):
    m = model_df(spark, sf)
    inv = {c: {v: k for k, v in mp.items()} for c, mp in clean.FORM_CODE_MAPS.items()}
    form = clean.map_codes(m, inv, suffix="_form")
    fwd = form.select("customerid", *[F.col(c + "_form").alias(c) for c in inv])
    coded = clean.map_codes(fwd, clean.FORM_CODE_MAPS, suffix="_code")
    return coded.select("customerid", *[F.col(c).alias(c + "_form") for c in inv],
                        *[c + "_code" for c in inv])


@query("checkbox_codes", with_views(
    "SELECT customerid, CASE WHEN seniorcitizen = 1 THEN 'Yes' ELSE 'No' END AS senior_flag,"
    " CAST(CASE WHEN partner = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS partner_flag FROM model"))
def q_checkbox_codes(spark, sf):
    m = model_df(spark, sf).select("customerid", (F.col("seniorcitizen") == 1).alias("senior_flag"),
                                   (F.col("partner") == "Yes").alias("partner_flag"))
    m = clean.checkbox_codes(m, ["senior_flag"])
    return clean.checkbox_codes(m, ["partner_flag"], as_int=True).withColumn(
        "partner_flag", F.col("partner_flag").cast("int"))


def _rules_sql() -> str:
    parts = [f"SELECT '{n}' AS rule, count(*) FILTER (WHERE coalesce(({e}), false)) AS violations,"
             f" count(*) AS checked FROM features" for n, e in clean.DEFAULT_RULES.items()]
    return with_views(" UNION ALL ".join(parts))


@query("quality_rules", _rules_sql())
def q_quality_rules(spark, sf):
    return clean.quality_rules(clean.feature_view(_clean(spark, sf)))


# ---------------------------------------------------------------- sources (§2.1), round trips

def _round_trip(spark, df, fmt: str):
    return io.round_trip(df, scratch_path(spark, f"{fmt}-{uuid.uuid4().hex[:12]}"), fmt)


@query("parquet_snapshot", with_views("SELECT * FROM model"))
def q_parquet_snapshot(spark, sf):
    return _round_trip(spark, model_df(spark, sf), "parquet")


@query("csv_new_customers", with_views("SELECT * EXCLUDE (target) FROM model"))
def q_csv_new_customers(spark, sf):
    return _round_trip(spark, model_df(spark, sf).drop("target"), "csv")


@query("csv_predictions", with_views(
    "SELECT customerid, target AS y_true, score AS prob_churn, CAST(score >= 0.46e0 AS INTEGER) AS pred_churn"
    " FROM scored"))
def q_csv_predictions(spark, sf):
    d = scored_df(spark, sf).select("customerid", F.col("target").alias("y_true"),
                                    F.col("score").alias("prob_churn"),
                                    (F.col("score") >= 0.46).cast("int").alias("pred_churn"))
    return _round_trip(spark, d, "csv")


@query("json_artifacts", with_views(
    "SELECT coalesce(max(score) FILTER (WHERE tp / tot_pos >= 0.8e0), 0e0) AS threshold,"
    " 0.8e0 AS min_recall_target_val, ['customerid'] AS id_cols_dropped, CAST([] AS VARCHAR[]) AS drop_cols_global,"
    " CAST([] AS VARCHAR[]) AS drop_cols_model, CAST(NULL AS VARCHAR[]) AS cat_cols"
    " FROM (SELECT score, sum(target) OVER (ORDER BY score DESC) AS tp, sum(target) OVER () AS tot_pos"
    "       FROM (SELECT score, CAST(sum(target) AS BIGINT) AS target FROM scored GROUP BY score))"))
def q_json_artifacts(spark, sf):
    s = scored_df(spark, sf).select(F.col("target").alias("label"), "score")
    thr = threshold_min_recall(s, min_recall=0.8)
    params = thr.select(
        F.col("threshold"), F.lit(0.8).alias("min_recall_target_val"),
        F.array(F.lit("customerid")).alias("id_cols_dropped"),
        F.array().cast("array<string>").alias("drop_cols_global"),
        F.array().cast("array<string>").alias("drop_cols_model"),
        F.lit(None).cast("array<string>").alias("cat_cols"))
    path = scratch_path(spark, f"params-{uuid.uuid4().hex[:12]}")
    io.write_params(params, path)
    return io.read_params(spark, path)
