import pytest
from pyspark.sql import functions as F

from attrition.operators import economics as eco
from attrition.operators import split as sp


def test_impact_projection_worked_example(spark):
    # 10,000 customers, 20% churn, mean ticket 200 -> 4.8M at risk, 1.44M saved
    rows = [(i, 1 if i < 2000 else 0, 200.0) for i in range(10000)]
    df = spark.createDataFrame(rows, "k int, target int, monthlycharges double").withColumn("seg", F.lit("all"))
    r = eco.impact_projection(df, segment="seg").first()
    assert r.annual_at_risk == pytest.approx(4_800_000) and r.saved == pytest.approx(1_440_000)


def test_campaign_roi_empty_is_null(spark):
    df = spark.createDataFrame([(0.1, 10.0)], "score double, monthlycharges double")
    r = eco.campaign_roi(df, threshold=0.46).first()
    assert r.customers_at_risk == 0 and r.roi is None


def test_threshold_counts_brute(spark):
    import random
    rnd = random.Random(5)
    rows = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(500)] + [(0.46, 1), (0.05, 0), (0.95, 1)]
    df = spark.createDataFrame(rows, "score double, target int")
    got = {r.threshold: (r.contacted, r.tp) for r in eco.threshold_counts(df).collect()}
    for t in eco.slider():
        want = (sum(1 for s, _ in rows if s >= t), sum(y for s, y in rows if s >= t))
        assert got[t] == want


def test_split_sizes_match_published_supports(spark):
    rows = [(f"id{i}", 1 if i < 1869 else 0) for i in range(7032)]
    df = spark.createDataFrame(rows, "id string, target int")
    out = sp.stratified_split(df, id_col="id", target="target").groupBy("split", "target").count().collect()
    got = {(r.split, r.target): r["count"] for r in out}
    assert got == {("test", 0): 1033, ("test", 1): 374, ("val", 0): 1033, ("val", 1): 374,
                   ("train", 0): 3097, ("train", 1): 1121}


def test_split_disjoint_complete_and_partition_independent(spark):
    rows = [(f"id{i}", i % 3 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, t boolean").withColumn("target", F.col("t").cast("int"))
    a = {r.id: r.split for r in sp.stratified_split(df.repartition(1), id_col="id", target="target").collect()}
    b = {r.id: r.split for r in sp.stratified_split(df.repartition(13), id_col="id", target="target").collect()}
    assert len(a) == 900 and a == b


def test_class_weight(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "target int")
    w = sorted({(r.target, r.weight) for r in sp.class_weight(df, target="target").collect()})
    assert w == [(0, 1.0), (1, 3.0)]
    only_neg = spark.createDataFrame([(0,)], "target int")
    assert sp.class_weight_summary(only_neg, target="target").first().scale_pos_weight == 1.0
