"""Registry of named queries: each is (spark, sf_dir) -> DataFrame, with an
optional SQL twin for the DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}

# Ratios and amounts that a registered query rounds, so that two engines agree on
# them: column -> decimal places. Operators themselves never round.
ROUNDED = dict.fromkeys("""
    amount annual_at_risk auc average_precision avg_score baseline benefit campaign_cost change
    churn_rate ci_hi ci_lo contribution corr cost cum_base cum_churn cum_clients_pct cum_customers_pct cum_gain
    cum_revenue_pct efficiency f1 fpr gain gap iqr ks lift limit mean mean_value median pct_base_contacted
    pct_churn_captured percent potential_saved precision prob_hi prob_lo prob_pred prob_true profit q1 q25
    q3 q50 q75 recall retained return_per_unit revenue revenue_at_risk revenue_at_risk_month
    revenue_at_risk_year roi roi_pct running saved scale_pos_weight share std ticket tpr x
    auc_train auc_val auc_test ap_train ap_val ap_test ks_test precision_test recall_test""".split(), 6)
ROUNDED["density"] = 15


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """The double columns named in ``places`` rounded; other columns as they are."""
    return df.withColumns({c: F.round(c, places[c]) for c, t in df.dtypes if t == "double" and c in places})


def query(name: str, sql: str | None = None, places: dict[str, int] | None = None
          ) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``places`` adds to or overrides ``ROUNDED``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), ROUNDED | (places or {}))
        REGISTRY[name] = Query(name, run, sql)
        return run
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from . import queries_core, queries_econ, queries_eval, queries_model, queries_profile  # noqa: F401
    return REGISTRY
