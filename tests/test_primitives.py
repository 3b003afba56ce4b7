import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from attrition.operators.primitives import exact_quantiles, prefix_sums, running_rows, score_histogram


def _frame(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one hot score holds a third of all rows
        s = 0.5 if i % 3 == 0 else round(rnd.random(), 2)
        rows.append((f"id{i}", s, rnd.randint(0, 1), float(rnd.randint(1, 100))))
    return spark.createDataFrame(rows, "id string, score double, label int, value double")


def _brute(pdf):
    pdf = pdf.copy()
    pdf["md5"] = pdf.id.map(lambda s: hashlib.md5(s.encode()).hexdigest())
    pdf = pdf.sort_values(["score", "md5", "id"], ascending=[False, True, True]).reset_index(drop=True)
    pdf["pos"] = np.arange(1, len(pdf) + 1)
    pdf["cum_value"] = pdf.value.cumsum()
    pdf["cum_label"] = pdf.label.cumsum()
    return pdf.set_index("id")


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_running_rows_matches_brute_force_under_repartition(spark, parts):
    df = _frame(spark).repartition(parts)
    got = running_rows(df, order="score", id_col="id", values=["value", "label"]).toPandas().set_index("id")
    want = _brute(df.toPandas())
    got = got.loc[want.index]
    assert (got["pos"].values == want["pos"].values).all()
    assert np.allclose(got["cum_value"].values, want["cum_value"].values)
    assert (got["cum_label"].values == want["cum_label"].values).all()


def test_running_rows_by_group(spark):
    df = _frame(spark, 800)
    got = running_rows(df, order="score", id_col="id", by=["label"]).toPandas()
    for lab, g in got.groupby("label"):
        assert sorted(g.pos) == list(range(1, len(g) + 1))


def test_prefix_sums_quantile_bucket(spark):
    rows = [(float(v), 1) for v in range(-500, 500, 3)]
    df = spark.createDataFrame(rows, "x double, n long")
    out = prefix_sums(df, [("x", True)], ["n"], bucket="quantile").toPandas().sort_values("x")
    assert (out["cum_n"].values == np.arange(1, len(rows) + 1)).all()


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5]) if i % 2 else rnd.random() * 100 for i in range(999)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "v double, g int")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, "v", probs).toPandas().sort_values("pi")
    assert np.allclose(got.q.values, np.quantile(np.array(vals), probs))
    by = exact_quantiles(df, "v", probs, by=["g"]).toPandas()
    for g, part in by.groupby("g"):
        ref = np.quantile(np.array([v for i, v in enumerate(vals) if i % 3 == g]), probs)
        assert np.allclose(part.sort_values("pi").q.values, ref)


def test_histogram_counts(spark):
    df = _frame(spark, 300)
    h = score_histogram(df).toPandas()
    assert h.n.sum() == 300 and (h.pos + h.neg == h.n).all()
