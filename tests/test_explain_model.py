import random

from pyspark.sql import functions as F

from attrition.operators import explain as xp
from attrition.operators import model as ml


def _fit(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        c = rnd.choice(["a", "b", "c"])
        x = rnd.random() * 10
        y = 1 if (x > 6 or c == "b") and rnd.random() > 0.2 else 0
        rows.append((f"k{i}", c, x, float(rnd.randint(0, 5)), y))
    df = spark.createDataFrame(rows, "id string, cat string, x double, z double, target int")
    model = ml.fit_boosted(df, ["cat"], ["x", "z"], {"maxIter": 5, "maxDepth": 3}, weight_col=None)
    return df, model


def test_contributions_add_up_to_margin(spark):
    df, model = _fit(spark)
    c = xp.contributions(df, model, id_col="id")
    tot = c.groupBy("id").agg(F.sum("contribution").alias("s"))
    m = xp.margin(df, model, id_col="id")
    d = tot.join(m, "id").select(F.max(F.abs(F.col("s") - F.col("margin"))).alias("d")).first().d
    assert d < 1e-9


def test_single_row_scores_like_batch(spark):
    df, model = _fit(spark)
    whole = {r.id: r.probability[1] for r in model.transform(df).collect()}
    one = df.limit(1)
    r = model.transform(one).first()
    assert abs(whole[r.id] - r.probability[1]) < 1e-12


def test_top_factors_ranks(spark):
    long = spark.createDataFrame([("a", "f1", 0.5), ("a", "f2", -0.7), ("a", "f3", 0.1), ("a", "__bias__", 9.0)],
                                 "id string, feature string, contribution double")
    got = [(r.rank, r.feature, r.direction) for r in xp.top_factors(long, id_col="id", n=2).orderBy("rank").collect()]
    assert got == [(1, "f2", "↓ reduz churn"), (2, "f1", "↑ aumenta churn")]
