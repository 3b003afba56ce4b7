"""Test-table adapter: a subscriber table in the raw shape, derived from the
customer / orders / lineitem / part tables, plus a formula score.

The same rules are written once as DataFrame code and once as SQL so the
oracle can rebuild every downstream result from the base tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW, SERVICE_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Part type assigned to each add-on service, in service order.
ADDON_PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

# Payment method by customer key modulo 4.
PAYMENT_BY_MOD4 = [
    "Mailed check", "Electronic check", "Bank transfer (automatic)", "Credit card (automatic)",
]


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-shaped subscriber table (one row per customer).

    Plan: orders are filtered to status P once and aggregated per customer;
    returned lines (R/F) are reduced to one row per order with six type flags
    *before* the join to orders, so the order-key shuffle carries one row
    per order instead of one per line. All three customer-keyed inputs are
    then hash partitioned on the customer key; AQE decides at run time
    whether part or the aggregates are small enough to broadcast.
    """
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    porders = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == "P")
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    )
    per_cust = porders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("d0"),
        F.max("o_orderdate").alias("d1"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("tot"),
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
        .select("l_orderkey", "l_partkey")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    flags = [F.max(F.when(F.col("p_type") == t, 1).otherwise(0)).alias(f"f{i}")
             for i, t in enumerate(ADDON_PART_TYPES)]
    per_order = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("l_orderkey").agg(*flags)
    )
    addons = (
        per_order.join(porders.select("o_orderkey", "o_custkey"),
                       per_order.l_orderkey == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(*[F.max(f"f{i}").alias(f"f{i}") for i in range(len(ADDON_PART_TYPES))])
        .withColumnRenamed("o_custkey", "a_custkey")
    )
    base = (
        cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
        .join(addons, cust.c_custkey == addons.a_custkey, "left")
    )

    k = F.col("c_custkey")
    u = (k * 7919 + 104729) % 1000
    tenure = F.coalesce(
        F.least(F.lit(72), F.floor(F.datediff(F.col("d1"), F.col("d0")) / F.lit(30.0))),
        F.lit(0),
    ).cast("int")
    no_internet = F.col("c_mktsegment") == "BUILDING"
    internet = (
        F.when(no_internet, "No")
        .when(F.col("c_mktsegment").isin("AUTOMOBILE", "FURNITURE"), "Fiber optic")
        .otherwise("DSL")
    )
    contract = (
        F.when(k % 6 < 3, "Month-to-month").when(k % 6 < 5, "One year").otherwise("Two year")
    )
    payment = F.element_at(F.array(*[F.lit(p) for p in PAYMENT_BY_MOD4]), (k % 4 + 1).cast("int"))

    def addon(i: int) -> Column:
        return (F.when(no_internet, "No internet service")
                .when(F.col(f"f{i}") == 1, "Yes").otherwise("No"))

    def yes_no(cond: Column) -> Column:
        return F.when(cond, "Yes").otherwise("No")

    ten = F.col("tenure")
    base_rate = F.when(F.col("contract") == "Month-to-month", 450).when(
        F.col("contract") == "One year", 150).otherwise(50)
    stage_bonus = F.when(ten <= 6, 250).when(ten <= 24, 100).otherwise(0)

    out = (
        base.select(
            F.col("c_name").alias("customerid"),
            F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
            F.when(k % 6 == 0, 1).otherwise(0).cast("int").alias("seniorcitizen"),
            yes_no(k % 3 == 0).alias("partner"),
            yes_no(k % 5 == 0).alias("dependents"),
            tenure.alias("tenure"),
            yes_no(k % 10 != 0).alias("phoneservice"),
            F.when(k % 10 == 0, "No phone service").when(k % 2 == 0, "Yes").otherwise("No")
            .alias("multiplelines"),
            internet.alias("internetservice"),
            *[addon(i).alias(c) for i, c in enumerate(SERVICE_COLUMNS)],
            contract.alias("contract"),
            yes_no(k % 7 < 4).alias("paperlessbilling"),
            payment.alias("paymentmethod"),
            F.round(F.lit(18.25) + (k * 31) % 10000 / F.lit(100.0), 2).alias("monthlycharges"),
            F.coalesce(F.col("tot").cast("string"), F.lit(" ")).alias("totalcharges"),
            u.alias("_u"),
        )
        .withColumn(
            "churn",
            F.when(F.col("_u") >= 990, "Unknown")
            .when(F.col("_u") < base_rate + stage_bonus, "Yes")
            .otherwise("No"),
        )
        .drop("_u")
    )
    return out.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW.fields])


def formula_score(tenure: str = "tenure", monthly: str = "monthlycharges",
                  services: str = "total_services", contract: str = "contract") -> Column:
    """Model-free churn score used where results must be checkable in SQL."""
    z = (F.when(F.col(contract) == "Month-to-month", 1.2).otherwise(0.0)
         - F.lit(0.03) * F.col(tenure)
         + F.lit(0.01) * F.col(monthly)
         - F.lit(0.15) * F.col(services))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 4)


# ---------------------------------------------------------------- SQL twins

SUBSCRIBERS_SQL = """
SELECT customerid, gender, seniorcitizen, partner, dependents, tenure, phoneservice,
       multiplelines, internetservice, onlinesecurity, onlinebackup, deviceprotection,
       techsupport, streamingtv, streamingmovies, contract, paperlessbilling, paymentmethod,
       monthlycharges, totalcharges,
       CASE WHEN u >= 990 THEN 'Unknown'
            WHEN u < (CASE WHEN contract = 'Month-to-month' THEN 450
                           WHEN contract = 'One year' THEN 150 ELSE 50 END)
                   + (CASE WHEN tenure <= 6 THEN 250 WHEN tenure <= 24 THEN 100 ELSE 0 END)
            THEN 'Yes' ELSE 'No' END AS churn
FROM (
  SELECT c.c_name AS customerid,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         CAST(CASE WHEN c.c_custkey % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS seniorcitizen,
         CASE WHEN c.c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS partner,
         CASE WHEN c.c_custkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS dependents,
         CAST(coalesce(least(72, floor(date_diff('day', pc.d0, pc.d1) / 30e0)), 0) AS INTEGER) AS tenure,
         CASE WHEN c.c_custkey % 10 != 0 THEN 'Yes' ELSE 'No' END AS phoneservice,
         CASE WHEN c.c_custkey % 10 = 0 THEN 'No phone service'
              WHEN c.c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS multiplelines,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'No'
              WHEN c.c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'Fiber optic'
              ELSE 'DSL' END AS internetservice,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN a.f0 = 1 THEN 'Yes' ELSE 'No' END AS onlinesecurity,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN a.f1 = 1 THEN 'Yes' ELSE 'No' END AS onlinebackup,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN a.f2 = 1 THEN 'Yes' ELSE 'No' END AS deviceprotection,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN a.f3 = 1 THEN 'Yes' ELSE 'No' END AS techsupport,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN a.f4 = 1 THEN 'Yes' ELSE 'No' END AS streamingtv,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'No internet service' WHEN a.f5 = 1 THEN 'Yes' ELSE 'No' END AS streamingmovies,
         CASE WHEN c.c_custkey % 6 < 3 THEN 'Month-to-month'
              WHEN c.c_custkey % 6 < 5 THEN 'One year' ELSE 'Two year' END AS contract,
         CASE WHEN c.c_custkey % 7 < 4 THEN 'Yes' ELSE 'No' END AS paperlessbilling,
         CASE c.c_custkey % 4 WHEN 0 THEN 'Mailed check' WHEN 1 THEN 'Electronic check'
              WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS paymentmethod,
         round(18.25e0 + (c.c_custkey * 31) % 10000 / 100e0, 2) AS monthlycharges,
         coalesce(CAST(pc.tot AS VARCHAR), ' ') AS totalcharges,
         (c.c_custkey * 7919 + 104729) % 1000 AS u
  FROM customer c
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d0, max(o_orderdate) AS d1,
                    sum(CAST(o_totalprice AS DECIMAL(18,2))) AS tot
             FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) pc
         ON c.c_custkey = pc.o_custkey
  LEFT JOIN (SELECT o.o_custkey,
                    max(f0) AS f0, max(f1) AS f1, max(f2) AS f2, max(f3) AS f3, max(f4) AS f4, max(f5) AS f5
             FROM (SELECT l.l_orderkey,
                          max(CASE WHEN p.p_type = 'ECONOMY' THEN 1 ELSE 0 END) AS f0,
                          max(CASE WHEN p.p_type = 'LARGE' THEN 1 ELSE 0 END) AS f1,
                          max(CASE WHEN p.p_type = 'MEDIUM' THEN 1 ELSE 0 END) AS f2,
                          max(CASE WHEN p.p_type = 'PROMO' THEN 1 ELSE 0 END) AS f3,
                          max(CASE WHEN p.p_type = 'SMALL' THEN 1 ELSE 0 END) AS f4,
                          max(CASE WHEN p.p_type = 'STANDARD' THEN 1 ELSE 0 END) AS f5
                   FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                   WHERE l.l_returnflag = 'R' AND l.l_linestatus = 'F'
                   GROUP BY l.l_orderkey) lo
             JOIN orders o ON lo.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'P'
             GROUP BY o.o_custkey) a
         ON c.c_custkey = a.o_custkey
) s
"""

FORMULA_SCORE_SQL = (
    "round(1e0 / (1e0 + exp(-((CASE WHEN contract = 'Month-to-month' THEN 1.2e0 ELSE 0e0 END)"
    " - 0.03e0 * tenure + 0.01e0 * monthlycharges - 0.15e0 * total_services))), 4)"
)
