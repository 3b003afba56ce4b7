"""Registered queries: profiling and EDA tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as pf
from ..schemas import CONTRACT_ORDER, MODEL, NUMERIC_COLUMNS, PAYMENT_ORDER, RAW, STAGE_ORDER
from .base import model_df
from .catalog import query
from .sql import with_views
from .subscribers import subscribers

_TYPE = {"IntegerType()": "int", "DoubleType()": "double", "StringType()": "string"}


def _schema_sql() -> str:
    parts = [
        f"SELECT CAST({i} AS INTEGER) AS position, '{f.name}' AS column_name,"
        f" '{_TYPE[repr(f.dataType)]}' AS dtype, count({f.name}) AS non_null, count(*) AS rows FROM model"
        for i, f in enumerate(MODEL.fields)]
    return with_views(" UNION ALL ".join(parts))


@query("profile_schema", _schema_sql())
def q_profile_schema(spark, sf):
    return pf.profile_schema(model_df(spark, sf))


def _nulls_sql() -> str:
    cols = [f.name for f in RAW.fields]
    parts = [f"SELECT 'nulls:{c}' AS metric, count(*) FILTER (WHERE {c} IS NULL) AS value FROM subscribers"
             for c in cols]
    parts.append("SELECT 'duplicate_rows', CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM"
                 f" (SELECT count(*) AS k FROM subscribers GROUP BY {', '.join(cols)})")
    return with_views(" UNION ALL ".join(parts))


@query("profile_nulls_dups", _nulls_sql())
def q_profile_nulls_dups(spark, sf):
    return pf.profile_nulls_dups(subscribers(spark, sf))


def _long_sql(cols, src="model", extra=()) -> str:
    keep = "".join(f"{e}, " for e in extra)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {keep}CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols)


@query("describe_numeric", with_views("""
SELECT variable, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
       round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
       max(value) AS max
FROM lng WHERE value IS NOT NULL GROUP BY variable""", ("lng", _long_sql(NUMERIC_COLUMNS))))
def q_describe_numeric(spark, sf):
    return pf.describe_numeric(model_df(spark, sf), NUMERIC_COLUMNS)


@query("value_counts", with_views("SELECT paymentmethod AS value, count(*) AS n FROM model GROUP BY 1"))
def q_value_counts(spark, sf):
    return pf.value_counts(model_df(spark, sf), "paymentmethod")


@query("mean_by_target", with_views("""
SELECT target, round(avg(tenure), 6) AS mean, round(stddev_samp(tenure), 6) AS std, count(tenure) AS n
FROM model GROUP BY target"""))
def q_mean_by_target(spark, sf):
    return pf.mean_by_group(model_df(spark, sf), "tenure", "target")


@query("mean_by_target_ci")
def q_mean_by_target_ci(spark, sf):
    return pf.mean_bootstrap_ci(model_df(spark, sf), "tenure", "target", replicates=1000, seed=42)


@query("mean_by_target_ci_check", with_views("""
SELECT target, n, CAST(0 AS BIGINT) AS mismatches FROM (SELECT target, count(tenure) AS n FROM model GROUP BY target)"""))
def q_mean_by_target_ci_check(spark, sf):
    """The interval lies around the mean, and its half width is within 15 % of
    1.96 standard errors, where the bootstrap of so many rows must lie."""
    m = model_df(spark, sf)
    ci = pf.mean_bootstrap_ci(m, "tenure", "target", replicates=1000, seed=42)
    d = pf.mean_by_group(m, "tenure", "target").withColumnRenamed("mean", "m").join(ci, "target")
    half = 1.96 * F.col("std") / F.sqrt("n")
    near = (F.abs(F.col("mean") - F.col("ci_lo") - half) < 0.15 * half) & (
        F.abs(F.col("ci_hi") - F.col("mean") - half) < 0.15 * half)
    return d.select("target", "n", (~near).cast("long").alias("mismatches"))


def _box_sql(src_cte: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    using = f" USING ({k})" if keys else ""
    join = f"JOIN q{using}" if keys else ", q"
    grp = f" GROUP BY {k}" if keys else ""
    sel = f"{k}, " if keys else ""
    return with_views(f"""
SELECT {sel}count(*) AS n, round(min(q1), 6) AS q1, round(min(med), 6) AS median, round(min(q3), 6) AS q3,
       round(min(q3) - min(q1), 6) AS iqr, min(value) FILTER (WHERE value >= lo) AS whisker_lo,
       max(value) FILTER (WHERE value <= hi) AS whisker_hi,
       count(*) FILTER (WHERE value < lo OR value > hi) AS outliers
FROM (SELECT s.*, q1, med, q3, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi
      FROM s {join})
{grp}""", ("s", src_cte),
        ("q", f"SELECT {sel}quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,"
              f" quantile_cont(value, 0.75) AS q3 FROM s{grp}"))


@query("boxplot_by_target", _box_sql(_long_sql(["monthlycharges", "totalcharges"], extra=["target"]),
                                     ["variable", "target"]))
def q_boxplot_by_target(spark, sf):
    m = model_df(spark, sf)
    long = m.selectExpr("target", pf._stack(["monthlycharges", "totalcharges"]))
    return pf.boxplot_stats(long, "value", group=["variable", "target"])


@query("boxplot_by_contract", _box_sql(
    "SELECT contract, CAST(list_position(['Month-to-month', 'One year', 'Two year'], contract) AS INTEGER)"
    " AS sort_key, monthlycharges AS value FROM model", ["contract", "sort_key"]))
def q_boxplot_by_contract(spark, sf):
    m = model_df(spark, sf).select(
        "contract", F.array_position(F.array(*[F.lit(c) for c in CONTRACT_ORDER]), F.col("contract"))
        .cast("int").alias("sort_key"), F.col("monthlycharges").alias("value"))
    return pf.boxplot_stats(m, "value", group=["contract", "sort_key"])


@query("boxplot_single", _box_sql("SELECT totalcharges AS value FROM model", []))
def q_boxplot_single(spark, sf):
    return pf.boxplot_stats(model_df(spark, sf).select(F.col("totalcharges").alias("value")), "value")


@query("scatter_bins", with_views("""
SELECT CAST(floor(tenure / 6e0) AS BIGINT) AS bx, CAST(floor(totalcharges / 500000e0) AS BIGINT) AS by,
       target, count(*) AS n FROM model GROUP BY 1, 2, 3"""))
def q_scatter_bins(spark, sf):
    return pf.scatter_bins(model_df(spark, sf), "tenure", "totalcharges", "target", 6, 500000)


@query("iqr_outliers", with_views("""
SELECT round(lim, 6) AS limit, count(*) AS outliers, round(avg(monthlycharges), 6) AS mean_value,
       (SELECT contract FROM o GROUP BY contract ORDER BY count(*) DESC, contract LIMIT 1) AS mode_value
FROM o, l GROUP BY lim""",
    ("l", "SELECT quantile_cont(totalcharges, 0.75) + 1.5e0 * (quantile_cont(totalcharges, 0.75)"
          " - quantile_cont(totalcharges, 0.25)) AS lim FROM model WHERE target = 1"),
    ("o", "SELECT m.* FROM model m, l WHERE m.target = 1 AND m.totalcharges > l.lim")))
def q_iqr_outliers(spark, sf):
    return pf.iqr_outliers(model_df(spark, sf), value="totalcharges", where=F.col("target") == 1,
                           mean_col="monthlycharges", mode_col="contract")


@query("kde_by_target", with_views("""
SELECT target, CAST(i AS INTEGER) AS i, round(x, 6) AS x,
       round(sum(c * exp(-0.5e0 * ((x - totalcharges) / bw) * ((x - totalcharges) / bw)))
             / (max(n) * max(bw) * sqrt(2 * pi())), 15) AS density
FROM (SELECT h.target, h.totalcharges, h.c, st.n, st.bw, g.i,
             CASE WHEN g.i = 199 THEN st.hi ELSE st.lo + g.i * st.step END AS x
      FROM h JOIN st USING (target), (SELECT range AS i FROM range(200)) g)
GROUP BY target, i, x""",
    ("h", "SELECT target, totalcharges, count(*) AS c FROM model WHERE totalcharges IS NOT NULL GROUP BY 1, 2"),
    ("st0", "SELECT target, count(*) AS n, stddev_samp(totalcharges) * pow(CAST(count(*) AS DOUBLE), -0.2e0) AS bw,"
            " min(totalcharges) AS mn, max(totalcharges) AS mx FROM model WHERE totalcharges IS NOT NULL GROUP BY 1"),
    ("st", "SELECT *, mn - 3e0 * bw AS lo, mx + 3e0 * bw AS hi, ((mx + 3e0 * bw) - (mn - 3e0 * bw)) / 199e0 AS step"
           " FROM st0")))
def q_kde_by_target(spark, sf):
    return pf.kde(model_df(spark, sf), "totalcharges", "target", grid=200, cut=3.0)


@query("churn_by_contract", with_views("SELECT contract, target, count(*) AS n FROM model GROUP BY 1, 2"))
def q_churn_by_contract(spark, sf):
    return pf.cross_counts(model_df(spark, sf), "contract", "target")


def _order_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("churn_by_payment", with_views(f"""
SELECT paymentmethod, target, count(*) AS n,
       CAST(list_position({_order_list(PAYMENT_ORDER)}, paymentmethod) AS INTEGER) AS sort_key
FROM model WHERE paymentmethod IN ({', '.join(f"'{v}'" for v in PAYMENT_ORDER)}) GROUP BY 1, 2"""))
def q_churn_by_payment(spark, sf):
    return pf.cross_counts(model_df(spark, sf), "paymentmethod", "target", order=PAYMENT_ORDER)


@query("churn_by_stage", with_views(f"""
SELECT customer_lifecycle_stage, target, count(*) AS n,
       CAST(list_position({_order_list(STAGE_ORDER)}, customer_lifecycle_stage) AS INTEGER) AS sort_key
FROM model WHERE customer_lifecycle_stage IN ({', '.join(f"'{v}'" for v in STAGE_ORDER)}) GROUP BY 1, 2"""))
def q_churn_by_stage(spark, sf):
    return pf.cross_counts(model_df(spark, sf), "customer_lifecycle_stage", "target", order=STAGE_ORDER)


@query("churn_share", with_views("""
SELECT contract, churners, round(churners / sum(churners) OVER (), 6) AS share
FROM (SELECT contract, count(*) AS churners FROM model WHERE target = 1 GROUP BY contract)"""))
def q_churn_share(spark, sf):
    return pf.churn_share(model_df(spark, sf), "contract")


def _corr_sql() -> str:
    cols = NUMERIC_COLUMNS
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)"
             f" AS corr FROM model" for a, b in pairs]
    return with_views(" UNION ALL ".join(parts))


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf):
    return pf.correlation_matrix(model_df(spark, sf), NUMERIC_COLUMNS)
