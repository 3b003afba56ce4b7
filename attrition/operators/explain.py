"""Per-row feature contributions of the boosted trees, and their summaries.

Contributions are the exact Shapley values of the path-dependent tree
expectation (the quantity TreeSHAP computes): for each tree, v(S) is the
prediction when features in S follow the row and the others follow the
training cover at each split. They are added up leaf by leaf in polynomial
time, vectorised over the rows of an Arrow batch. Trees are small driver-side metadata, broadcast once;
rows never leave their partition (``mapInPandas``).

Contributions are in log-odds: Spark's booster has half of them as margin, so
they are doubled. Invariant: bias + sum of contributions = log-odds of the model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import feature_names


LOG_ODDS = 2.0  # probability = 1 / (1 + exp(-2 * margin))
# The direction texts.
RAISES, LOWERS = "↑ aumenta churn", "↓ reduz churn"


def _node_to_dict(node) -> dict:
    kind = node.getClass().getSimpleName()
    stats = node.impurityStats()
    cover = float(stats.count()) if stats is not None else 0.0
    if kind == "LeafNode":
        return {"leaf": True, "value": float(node.prediction()), "cover": cover}
    split = node.split()
    d = {"leaf": False, "feature": int(split.featureIndex()), "cover": cover,
         "left": _node_to_dict(node.leftChild()), "right": _node_to_dict(node.rightChild())}
    if split.getClass().getSimpleName() == "CategoricalSplit":
        d["categories"] = [float(c) for c in split.leftCategories()]
    else:
        d["threshold"] = float(split.threshold())
    return d


def extract_trees(model: PipelineModel) -> dict:
    """Tree structures and weights of the booster (small metadata)."""
    gbt = model.stages[-1]
    trees = [_node_to_dict(t._java_obj.rootNode()) for t in gbt.trees]
    return {"trees": trees, "weights": [float(w) for w in gbt.treeWeights],
            "names": feature_names(model), "n_features": int(gbt.numFeatures)}


def _leaves(tree: dict) -> list[list[tuple]]:
    """Root-to-leaf paths: [(node, went_left), ...] plus the leaf."""
    out = []

    def walk(node, path):
        if node["leaf"]:
            out.append((list(path), node))
            return
        walk(node["left"], path + [(node, True)])
        walk(node["right"], path + [(node, False)])

    walk(tree, [])
    return out


def _goes_left(node: dict, x: np.ndarray) -> np.ndarray:
    col = x[:, node["feature"]]
    if "categories" in node:
        return np.isin(col, node["categories"])
    return col <= node["threshold"]


def tree_shap(tree: dict, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(n_rows x n_features) contributions of one tree, and its expected
    value under the training cover.

    A leaf's share of v(S) is its value times one factor for each of the m features
    on its path: agreement with the row if the feature is in S, else the cover
    fraction. So Shapley values add up leaf by leaf, and the sums over subsets of a
    path are the coefficients of a polynomial of degree m - 1: O(leaves x m^3).
    """
    phi, expected = np.zeros((x.shape[0], x.shape[1])), 0.0
    for steps, leaf in _leaves(tree):
        agree: dict[int, np.ndarray] = {}
        frac: dict[int, float] = {}
        for node, left in steps:
            f, child = node["feature"], node["left"] if left else node["right"]
            agree[f] = agree.get(f, True) & (_goes_left(node, x) == left)
            frac[f] = frac.get(f, 1.0) * (child["cover"] / node["cover"] if node["cover"] > 0 else 0.0)
        expected += leaf["value"] * math.prod(frac.values())
        m = len(frac)
        weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
        for f in frac:
            # coefficient k: sum over subsets of k other features that are in S
            poly = [np.ones(x.shape[0])]
            for g in frac:
                if g != f:
                    poly = [(poly[k] * frac[g] if k < len(poly) else 0.0)
                            + (poly[k - 1] * agree[g] if k else 0.0) for k in range(len(poly) + 1)]
            phi[:, f] += leaf["value"] * (agree[f] - frac[f]) * sum(w * c for w, c in zip(weight, poly))
    return phi, expected


def shap_matrix(meta: dict, x: np.ndarray) -> tuple[np.ndarray, float]:
    phi = np.zeros_like(x, dtype=float)
    bias = 0.0
    for tree, w in zip(meta["trees"], meta["weights"]):
        p, e = tree_shap(tree, x)
        phi += LOG_ODDS * w * p
        bias += LOG_ODDS * w * e
    return phi, bias


def _features_frame(df: DataFrame, model: PipelineModel, id_col: str) -> DataFrame:
    x = df
    for st in model.stages[:-1]:
        x = st.transform(x)
    return x.select(id_col, vector_to_array("features").alias("_x"))


def contributions(df: DataFrame, model: PipelineModel, *, id_col: str) -> DataFrame:
    """Long table (id, feature, contribution) plus one '__bias__' row per id."""
    meta = extract_trees(model)
    spark = df.sparkSession
    bmeta = spark.sparkContext.broadcast(meta)
    names = meta["names"]
    feats = _features_frame(df, model, id_col)
    id_type = dict(feats.dtypes)[id_col]

    def run(batches):
        m = bmeta.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.vstack(pdf["_x"].to_numpy()).astype(float)
            phi, bias = shap_matrix(m, x)
            k = len(names)
            ids = np.repeat(pdf[id_col].to_numpy(), k + 1)
            feat = np.tile(np.array(names + ["__bias__"], dtype=object), len(pdf))
            val = np.hstack([phi, np.full((len(pdf), 1), bias)]).reshape(-1)
            yield pd.DataFrame({id_col: ids, "feature": feat, "contribution": val})

    return feats.mapInPandas(run, f"{id_col} {id_type}, feature string, contribution double")


def margin(df: DataFrame, model: PipelineModel, *, id_col: str) -> DataFrame:
    """Log-odds of the model per id, for the invariant."""
    out = model.transform(df)
    return out.select(id_col, (F.lit(LOG_ODDS) * vector_to_array("rawPrediction")[1]).alias("margin"))


def contributions_global(df: DataFrame, model: PipelineModel, *, id_col: str, top: int | None = 15) -> DataFrame:
    """Mean |contribution| per feature over all rows, top ``top``.

    A task adds up what its rows contribute and emits one row a feature, whatever the
    number of its rows (the window runs over one row per feature)."""
    meta = extract_trees(model)
    bmeta = df.sparkSession.sparkContext.broadcast(meta)
    names = meta["names"]

    def run(batches):
        total, n = np.zeros(len(names)), 0
        for pdf in batches:
            if not pdf.empty:
                phi, _ = shap_matrix(bmeta.value, np.vstack(pdf["_x"].to_numpy()).astype(float))
                total, n = total + np.abs(phi).sum(axis=0), n + len(pdf)
        if n:
            yield pd.DataFrame({"feature": names, "_s": total, "_n": n})

    parts = _features_frame(df, model, id_col).select("_x").mapInPandas(run, "feature string, _s double, _n long")
    g = parts.groupBy("feature").agg((F.sum("_s") / F.sum("_n")).alias("mean_abs"))
    w = Window.orderBy(F.desc("mean_abs"), F.asc("feature"))
    g = g.select("feature", "mean_abs", F.row_number().over(w).alias("rank"))
    return g if top is None else g.where(F.col("rank") <= top)


def top_factors(long_df: DataFrame, *, id_col: str, n: int = 5, feature: str = "feature",
                value: str = "contribution") -> DataFrame:
    """Top ``n`` features per id by |contribution| (ties by name), with the
    direction: > 0 raises churn risk, otherwise lowers it."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs(F.col(value))), F.asc(feature))
    r = long_df.where(F.col(feature) != "__bias__").withColumn("rank", F.row_number().over(w))
    return r.where(F.col("rank") <= n).select(
        id_col, F.col("rank").cast("int").alias("rank"), feature, value,
        F.when(F.col(value) > 0, RAISES).otherwise(LOWERS).alias("direction"))


def formula_contributions(df: DataFrame, *, id_col: str,
                          terms: Sequence[tuple[str, Column]]) -> DataFrame:
    """Long contributions of a linear score: one (id, feature, value) row
    per term, by ``stack`` (no join)."""
    cols = [F.col(id_col)] + [c.alias(f"_t{i}") for i, (_, c) in enumerate(terms)]
    wide = df.select(*cols)
    parts = ", ".join(f"'{name}', CAST(_t{i} AS DOUBLE)" for i, (name, _) in enumerate(terms))
    return wide.selectExpr(f"`{id_col}`", f"stack({len(terms)}, {parts}) AS (feature, contribution)")
