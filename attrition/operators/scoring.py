"""Scoring and segmentation.

Row-local work (bands, cuts, model transform) stays narrow; rankings go
through ``running_rows``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .primitives import running_rows, with_totals

# Risk bands, their lower limits and recommended actions.
RISK_BANDS = [
    ("Alto", 0.70, "Ofertar retenção imediata (desconto/upgrade + contato ativo)"),
    ("Médio", 0.40, "Campanha direcionada (benefícios + onboarding de serviços)"),
    ("Baixo", None, "Manter relacionamento (NPS, melhorias e cross-sell leve)"),
]

# Risk level cut (right-closed) edges and labels, in display order.
RISK_LEVELS = [("Baixo", 0.0, 0.3), ("Médio", 0.3, 0.6), ("Alto", 0.6, 1.0)]


def risk_band(df: DataFrame, score: str = "score", out: str = "risk_band",
              action_out: str = "action") -> DataFrame:
    """Band by lower limits (score >= .70 Alto, >= .40 Médio, else Baixo)
    plus the recommended action."""
    band: Column | None = None
    action: Column | None = None
    for name, lo, act in RISK_BANDS:
        if lo is None:
            band = band.otherwise(F.lit(name))
            action = action.otherwise(F.lit(act))
        else:
            cond = F.col(score) >= F.lit(lo)
            band = F.when(cond, name) if band is None else band.when(cond, name)
            action = F.when(cond, act) if action is None else action.when(cond, act)
    return df.withColumns({out: band, action_out: action})


def risk_level_cut(df: DataFrame, score: str = "score", out: str = "risk_level") -> DataFrame:
    """Right-closed bins (0, .3], (.3, .6], (.6, 1]; values outside (and
    exactly 0) get NULL."""
    level: Column | None = None
    for name, lo, hi in RISK_LEVELS:
        cond = (F.col(score) > F.lit(lo)) & (F.col(score) <= F.lit(hi))
        level = F.when(cond, name) if level is None else level.when(cond, name)
    return df.withColumn(out, level)


def risk_level_counts(df: DataFrame, score: str = "score") -> DataFrame:
    """Count and percentage per level, every level shown (0 when empty),
    NULL levels excluded from the total; ``sort_key`` gives display order."""
    lv = risk_level_cut(df, score).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    levels = spark.createDataFrame([(name, i) for i, (name, _, _) in enumerate(RISK_LEVELS)],
                                   "risk_level string, sort_key int")
    # three-row level table on the left; the counts side has at most four rows
    j = levels.join(F.broadcast(lv.where(F.col("risk_level").isNotNull())), "risk_level", "left")
    j = j.select("risk_level", "sort_key", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
    j = with_totals(j, j, {"_tot": F.sum("count")})
    return j.select("risk_level", "sort_key", "count",
                    F.try_divide(F.col("count") * 100.0, F.col("_tot").cast("double")).alias("percent"))


# Priority tiers by share of the base (top 10%, top 20%).
PRIORITY_TIERS = [("immediate", 0.10), ("campaign", 0.20)]


def priority_tier(df: DataFrame, *, score: str = "score", id_col: str,
                  tiers: Sequence[tuple[str, float]] = PRIORITY_TIERS,
                  rest: str = "monitor") -> DataFrame:
    """Tier by position in the score order: position <= floor(n * p)."""
    src = df
    r = running_rows(src, order=score, id_col=id_col)
    r = with_totals(r, src, {"_n": F.count(F.lit(1))})
    tier: Column | None = None
    for name, p in tiers:
        cond = F.col("pos") <= F.floor(F.col("_n") * F.lit(float(p)))
        tier = F.when(cond, name) if tier is None else tier.when(cond, name)
    tier = tier.otherwise(rest) if tier is not None else F.lit(rest)
    return r.withColumn("priority", tier).drop("_n")


def score_with_model(df: DataFrame, model, threshold: float, prob_out: str = "prob_churn",
                     pred_out: str = "pred_churn") -> DataFrame:
    """Apply a fitted pipeline: positive-class probability, prediction at
    ``threshold`` and the threshold used. Ids pass through. Narrow."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    prob = vector_to_array(F.col("probability"))[1]
    keep = [c for c in df.columns]
    return out.select(*keep, prob.alias(prob_out)).withColumns({
        pred_out: (F.col(prob_out) >= F.lit(float(threshold))).cast("int"),
        "threshold_used": F.lit(float(threshold)),
    })


def score_customers(df: DataFrame, model, params: Mapping, *, drop_ids: bool = False) -> DataFrame:
    """Batch scoring with saved serving parameters. The id stays as a
    pass-through column unless ``drop_ids`` (so results join back)."""
    if drop_ids:
        df = df.drop(*(params.get("id_cols_dropped") or []))
    df = df.drop(*(params.get("drop_cols_global") or []))
    return score_with_model(df, model, float(params["threshold"]))
