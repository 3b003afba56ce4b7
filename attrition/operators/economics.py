"""Revenue, ROI and campaign economics over a scored table.

All outputs are small aggregates. Per-row ordering (priority curve, ROI by
depth) goes through ``running_rows``; the threshold slider is evaluated in
one pass by bucketing each distinct score against the threshold list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .primitives import running_rows, score_histogram, top_sums, valid, with_totals


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def revenue_by(df: DataFrame, *, key: str, revenue: str = "monthlycharges",
               score: str | None = None, threshold: float | None = None) -> DataFrame:
    """Monthly revenue (and customer count) per segment, optionally only for
    rows scored at or above ``threshold``. One partial aggregate."""
    if score is not None and threshold is not None:
        df = df.where(F.col(score) >= F.lit(float(threshold)))
    return df.groupBy(key).agg(
        F.sum(revenue).alias("revenue_at_risk" if threshold is not None else "revenue"),
        F.count(F.lit(1)).alias("customers"),
    )


def risk_revenue_share(df: DataFrame, *, key: str, revenue: str = "monthlycharges",
                       score: str = "score", threshold: float = 0.46) -> DataFrame:
    """Revenue at risk per segment and its percentage of the at-risk total."""
    g = revenue_by(df, key=key, revenue=revenue, score=score, threshold=threshold)
    g = with_totals(g, g, {"_tot": F.sum("revenue_at_risk")})
    return g.select(key, "revenue_at_risk", "customers",
                    (_div(F.col("revenue_at_risk"), F.col("_tot")) * 100).alias("percent"))


def risk_waterfall(df: DataFrame, *, key: str, revenue: str = "monthlycharges",
                   score: str = "score", threshold: float = 0.46) -> DataFrame:
    """Waterfall steps: segments by amount (desc, then name), the running
    subtotal after each step, and a final Total row. The window runs over
    the handful of segment rows."""
    g = revenue_by(df, key=key, revenue=revenue, score=score, threshold=threshold) \
        .select(F.col(key).cast("string").alias("step"), F.col("revenue_at_risk").alias("amount"))
    w = Window.orderBy(F.desc("amount"), F.asc("step"))
    steps = g.select("step", "amount", F.row_number().over(w).alias("sort_key"),
                     F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    total = g.agg(F.lit("Total").alias("step"), F.sum("amount").alias("amount"),
                  (F.count(F.lit(1)) + 1).cast("int").alias("sort_key"),
                  F.sum("amount").alias("running"))
    return steps.unionByName(total).select(
        "step", F.col("amount").alias("amount"), F.col("sort_key").cast("int").alias("sort_key"),
        F.col("running").alias("running"))


def executive_kpis(df: DataFrame, *, label: str = "target", score: str = "score",
                   revenue: str = "monthlycharges", threshold: float = 0.46,
                   success: float = 0.30, months: int = 6, cost_per_customer: float = 50.0) -> DataFrame:
    """Headline figures in one aggregate: base size, churn rate, customers and
    monthly / annual revenue at risk, potential saved over ``months`` at
    ``success`` rate, campaign cost and ROI."""
    at_risk = F.col(score) >= F.lit(float(threshold))
    k = df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.col(label).cast("double")).alias("churn_rate"),
        F.count_if(at_risk).alias("customers_at_risk"),
        F.coalesce(F.sum(F.when(at_risk, F.col(revenue))), F.lit(0.0)).alias("rev"),
    )
    saved = F.col("rev") * float(months) * float(success)
    cost = F.col("customers_at_risk") * float(cost_per_customer)
    return k.select(
        "customers", F.col("churn_rate").alias("churn_rate"), "customers_at_risk",
        F.col("rev").alias("revenue_at_risk_month"), (F.col("rev") * 12.0).alias("revenue_at_risk_year"),
        saved.alias("potential_saved"), cost.alias("campaign_cost"),
        _div(saved - cost, cost).alias("roi"))


def campaign_roi(df: DataFrame, *, score: str = "score", revenue: str = "monthlycharges",
                 threshold: float = 0.46, success: float = 0.30, months: int = 6,
                 cost_per_customer: float = 50.0) -> DataFrame:
    """At-risk count and revenue at a fixed threshold, saved revenue, cost,
    ROI and ROI %. NULL ROI when nobody is at risk."""
    at = df.where(F.col(score) >= F.lit(float(threshold)))
    k = at.agg(F.count(F.lit(1)).alias("customers_at_risk"),
               F.coalesce(F.sum(revenue), F.lit(0.0)).alias("rev"))
    saved = F.col("rev") * float(months) * float(success)
    cost = F.col("customers_at_risk") * float(cost_per_customer)
    roi = _div(saved - cost, cost)
    return k.select("customers_at_risk", F.col("rev").alias("revenue_at_risk"),
                    saved.alias("saved"), cost.alias("cost"), roi.alias("roi"),
                    (roi * 100).alias("roi_pct"))


def priority_curve(df: DataFrame, *, id_col: str, score: str = "score",
                   revenue: str = "monthlycharges") -> DataFrame:
    """Per row by score desc: cumulative share of customers and revenue."""
    src = df.where(valid(df, score)).select(id_col, score, F.col(revenue).alias("_v"))
    r = running_rows(src, order=score, id_col=id_col, values=["_v"])
    r = with_totals(r, r, {"_n": F.count(F.lit(1)), "_tv": F.sum("_v")})
    return r.select(id_col, score, "pos", _div(F.col("pos"), F.col("_n")).alias("cum_clients_pct"),
                    _div(F.col("cum__v"), F.col("_tv")).alias("cum_revenue_pct"))


def roi_by_depth(df: DataFrame, *, id_col: str, score: str = "score", revenue: str = "monthlycharges",
                 depths: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5), success: float = 0.30,
                 cost_per_customer: float = 50.0, months: int = 6) -> DataFrame:
    """For each depth p: the top floor(n * p) customers by score, saved
    revenue, cost and ROI. Only rows tied on a boundary score are ranked."""
    src = df.select(id_col, score, F.col(revenue).alias("_v"))
    top = top_sums(src, order=score, id_col=id_col, values=["_v"], fractions=depths)
    long = top.select(F.round(F.col("p") * 100).alias("pct_clients"), F.col("k").alias("clients"),
                      F.col("top__v").alias("revenue"))
    saved = F.col("revenue") * float(months) * float(success)
    cost = F.col("clients") * float(cost_per_customer)
    return long.select(F.col("pct_clients").cast("int").alias("pct_clients"),
                       F.col("clients").cast("long").alias("clients"),
                       saved.alias("saved"), cost.alias("cost"),
                       _div(saved - cost, cost).alias("roi"))


def slider(lo: float = 0.05, hi: float = 0.95, step: float = 0.01) -> list[float]:
    """The threshold list of the simulation slider, rounded to 2 places."""
    n = int(round((hi - lo) / step))
    return [round(lo + i * step, 2) for i in range(n + 1)]


def threshold_counts(df: DataFrame, *, label: str = "target", score: str = "score",
                     thresholds: Sequence[float] | None = None) -> DataFrame:
    """For every threshold t: customers with score >= t and positives among
    them. Distinct scores are bucketed against the sorted threshold list
    (binary search), so the work is one histogram plus a suffix sum over at
    most len(thresholds) + 1 rows."""
    ts = sorted(set(thresholds or slider()))
    h = score_histogram(df, score, label)
    b = Bucketizer(splits=[float("-inf"), *ts, float("inf")], inputCol=score, outputCol="_j",
                   handleInvalid="keep")
    # _j = number of thresholds <= score
    per = b.transform(h).groupBy("_j").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    spark = df.sparkSession
    tdf = spark.createDataFrame([(k, float(t)) for k, t in enumerate(ts)], "k int, threshold double")
    # every bucket 0..len(ts) present, then a suffix sum over those few rows:
    # contacted(t_k) = sum of n over buckets _j >= k + 1
    full = spark.range(0, len(ts) + 1).select(F.col("id").cast("int").alias("_j")) \
        .join(F.broadcast(per.select(F.col("_j").cast("int").alias("_j"), "n", "pos")), "_j", "left")
    w = Window.orderBy(F.desc("_j")).rowsBetween(Window.unboundedPreceding, 0)
    suffix = full.select((F.col("_j") - 1).alias("k"),
                         F.sum(F.coalesce("n", F.lit(0))).over(w).alias("contacted"),
                         F.sum(F.coalesce("pos", F.lit(0))).over(w).alias("tp"))
    return tdf.join(suffix, "k").select("threshold", F.col("contacted").cast("long").alias("contacted"),
                                        F.col("tp").cast("long").alias("tp"))


def threshold_simulation(df: DataFrame, *, label: str = "target", score: str = "score",
                         thresholds: Sequence[float] | None = None, contact_cost: float = 5.0,
                         incentive_cost: float = 50.0, revenue_per_retained: float = 300.0,
                         success: float = 0.25) -> DataFrame:
    """Campaign economics at every slider threshold: contacted, TP,
    retained = TP * success, benefit, cost = contacted * contact + retained
    * incentive, profit, ROI (0 when cost is 0), loss flag and money back
    per unit spent (ROI + 1)."""
    c = threshold_counts(df, label=label, score=score, thresholds=thresholds)
    retained = F.col("tp") * float(success)
    benefit = retained * float(revenue_per_retained)
    cost = F.col("contacted") * float(contact_cost) + retained * float(incentive_cost)
    roi = F.when(cost > 0, (benefit - cost) / cost).otherwise(F.lit(0.0))
    return c.select("threshold", "contacted", "tp", retained.alias("retained"),
                    benefit.alias("benefit"), cost.alias("cost"),
                    (benefit - cost).alias("profit"), roi.alias("roi"),
                    ((benefit - cost) < 0).cast("int").alias("loss"),
                    (roi + 1).alias("return_per_unit"))


def strategy_efficiency(df: DataFrame, *, label: str = "target", score: str = "score",
                        thresholds: Sequence[float] | None = None) -> DataFrame:
    """Share of the base contacted, share of churn captured and their ratio
    at every slider threshold."""
    c = threshold_counts(df, label=label, score=score, thresholds=thresholds)
    c = with_totals(c, df.where(valid(df, score)), {
        "_n": F.count(F.lit(1)), "_p": F.sum(F.col(label).cast("long"))})
    base = _div(F.col("contacted"), F.col("_n"))
    cap = _div(F.col("tp"), F.col("_p"))
    return c.select("threshold", base.alias("pct_base_contacted"),
                    cap.alias("pct_churn_captured"), _div(cap, base).alias("efficiency"))


def impact_projection(df: DataFrame, *, segment: str, label: str = "target",
                      revenue: str = "monthlycharges", recovery: float = 0.30) -> DataFrame:
    """Per segment: base, churn rate, mean ticket; annual revenue at risk =
    base * rate * ticket * 12; saved = at risk * recovery."""
    g = df.groupBy(segment).agg(F.count(F.lit(1)).alias("base"),
                                F.avg(F.col(label).cast("double")).alias("rate"),
                                F.avg(revenue).alias("ticket"))
    at_risk = F.col("base") * F.col("rate") * F.col("ticket") * 12.0
    return g.select(segment, "base", F.col("rate").alias("churn_rate"), F.col("ticket").alias("ticket"),
                    at_risk.alias("annual_at_risk"), (at_risk * float(recovery)).alias("saved"))


def segment_alert(df: DataFrame, *, segment: str, label: str = "target", limit: float = 0.25) -> DataFrame:
    """Segments whose churn rate is above ``limit``."""
    g = df.groupBy(segment).agg(F.avg(F.col(label).cast("double")).alias("churn_rate"),
                                F.count(F.lit(1)).alias("customers"))
    return g.where(F.col("churn_rate") > float(limit)).select(
        segment, F.col("churn_rate").alias("churn_rate"), "customers")


def revenue_risk_change(df: DataFrame, *, time_col: str, amount: str) -> DataFrame:
    """Monthly amount and its change versus the calendar month before; NULL where
    that month has no rows. The window runs over one row per month."""
    m = df.groupBy(F.date_trunc("month", F.col(time_col)).cast("date").alias("month")).agg(
        F.sum(amount).alias("amount"))
    w = Window.orderBy("month")
    prev = F.when(F.lag("month").over(w) == F.add_months("month", -1), F.lag("amount").over(w))
    return m.select("month", "amount", _div(F.col("amount") - prev, prev).alias("change"))
