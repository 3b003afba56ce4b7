import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "part"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "revenue_at_risk" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def n(v):
        return round(v, 6) if isinstance(v, float) else (tuple(v) if isinstance(v, list) else v)
    return sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


FAST = ["raw_schema", "model_view", "risk_revenue_by_contract", "roc_auc", "pr_curve", "ks_signed",
        "threshold_min_recall", "lift_deciles", "gains_curve", "calibration_curve", "classification_report",
        "executive_kpis", "threshold_simulation", "roi_by_depth", "risk_level_counts", "describe_numeric",
        "boxplot_by_target", "correlation_matrix", "stratified_split", "lines_gain_at_top", "kde_by_target"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(ocols, cur.fetchall())
