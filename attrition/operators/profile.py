"""Profiling and exploratory aggregates: the table behind each chart.

Exact quartiles use ``exact_quantiles`` (histogram + distributed running
count), so no task holds all values of a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draws import poisson
from .primitives import exact_quantiles, join_groups, same_keys_join, with_totals


def _stack(cols: Sequence[str], value_type: str = "double") -> str:
    parts = ", ".join(f"'{c}', CAST(`{c}` AS {value_type})" for c in cols)
    return f"stack({len(cols)}, {parts}) AS (variable, value)"


def profile_schema(df: DataFrame) -> DataFrame:
    """(position, column_name, dtype, non_null, rows) in one aggregate pass."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    parts = ", ".join(f"{i}, '{c}', '{types[c]}', _c{i}" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {parts}) AS (position, column_name, dtype, non_null)",
                          "_rows AS rows").select(
        F.col("position").cast("int").alias("position"), "column_name", "dtype", "non_null", "rows")


def profile_nulls_dups(df: DataFrame) -> DataFrame:
    """(metric, value): NULL count per column, then fully duplicated rows
    (rows beyond the first of each identical group)."""
    cols = df.columns
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    parts = ", ".join(f"'nulls:{c}', _n{i}" for i, c in enumerate(cols))
    long = nulls.selectExpr(f"stack({len(cols)}, {parts}) AS (metric, value)")
    dups = (df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_k"))
            .agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("value"))
            .select(F.lit("duplicate_rows").alias("metric"), F.col("value").cast("long")))
    return long.unionByName(dups)


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles (linear), max per
    column — one unpivot, grouped by column name."""
    long = df.selectExpr(_stack(cols)).where(F.col("value").isNotNull())
    base = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["variable"])
    qw = q.groupBy("variable").agg(*[F.max(F.when(F.col("pi") == i, F.col("q"))).alias(n)
                                   for i, n in enumerate(["q25", "q50", "q75"])])
    return base.join(qw, "variable").select("variable", "count", "mean", "std", "min", "q25", "q50",
                                          "q75", "max")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n) frequencies (sort by n desc when displaying)."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def mean_by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias("mean"),
                                 F.stddev_samp(value).alias("std"),
                                 F.count(F.col(value)).alias("n"))


def boxplot_stats(df: DataFrame, value: str, group: Sequence[str] = (), whis: float = 1.5) -> DataFrame:
    """Five-number summary with whis * IQR whiskers at the furthest data
    point inside the limits, and the count of points outside."""
    by = list(group)
    v = df.where(F.col(value).isNotNull())
    q = exact_quantiles(v, value, [0.25, 0.5, 0.75], by=by)
    qw = q.groupBy(*by).agg(*[F.max(F.when(F.col("pi") == i, F.col("q"))).alias(n)
                              for i, n in enumerate(["q1", "median", "q3"])])
    lim_lo = F.col("q1") - float(whis) * (F.col("q3") - F.col("q1"))
    lim_hi = F.col("q3") + float(whis) * (F.col("q3") - F.col("q1"))
    qw = qw.withColumns({"_lo": lim_lo, "_hi": lim_hi})
    j = join_groups(v, qw, by) if by else with_totals(v, qw, {c: F.first(c) for c in
                                                       ["q1", "median", "q3", "_lo", "_hi"]})
    x = F.col(value)
    out = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(x >= F.col("_lo"), x)).alias("whisker_lo"),
        F.max(F.when(x <= F.col("_hi"), x)).alias("whisker_hi"),
        F.count_if((x < F.col("_lo")) | (x > F.col("_hi"))).alias("outliers"))
    return out.select(*by, "n", F.col("q1").alias("q1"), F.col("median").alias("median"),
                      F.col("q3").alias("q3"), (F.col("q3") - F.col("q1")).alias("iqr"),
                      "whisker_lo", "whisker_hi", "outliers")


def scatter_bins(df: DataFrame, x: str, y: str, group: str, width: float, height: float) -> DataFrame:
    """2-D bin counts (the scalable form of a scatter plot)."""
    return df.groupBy(F.floor(F.col(x) / float(width)).alias("bx"),
                      F.floor(F.col(y) / float(height)).alias("by"), F.col(group)) \
        .agg(F.count(F.lit(1)).alias("n"))


def iqr_outliers(df: DataFrame, *, value: str, where: Column, mean_col: str, mode_col: str,
                 whis: float = 1.5) -> DataFrame:
    """Among rows matching ``where``: limit = Q3 + whis * IQR of ``value``;
    count above it, mean of ``mean_col`` and most common ``mode_col``
    (ties: higher count, then smaller value)."""
    sub = df.where(where & F.col(value).isNotNull())
    q = exact_quantiles(sub, value, [0.25, 0.75])
    lim = q.agg((F.max(F.when(F.col("pi") == 1, F.col("q")))
                 + float(whis) * (F.max(F.when(F.col("pi") == 1, F.col("q")))
                                  - F.max(F.when(F.col("pi") == 0, F.col("q"))))).alias("limit"))
    o = with_totals(sub, lim, {"limit": F.first("limit")})
    o = o.where(F.col(value) > F.col("limit"))
    counts = o.groupBy(mode_col).agg(F.count(F.lit(1)).alias("_k"))
    # most common value; ties go to the smaller value
    mode = counts.agg(F.min_by(mode_col, F.struct((-F.col("_k")).alias("k"), F.col(mode_col).alias("v")))
                      .alias("mode_value"))
    stats = o.agg(F.count(F.lit(1)).alias("outliers"), F.avg(mean_col).alias("mean_value"))
    stats = with_totals(stats, lim, {"limit": F.first("limit")})
    stats = with_totals(stats, mode, {"mode_value": F.first("mode_value")})
    return stats.select(F.col("limit").alias("limit"), "outliers", "mean_value", "mode_value")


def kde(df: DataFrame, value: str, group: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group (separate normalisation), Scott
    bandwidth std * n^(-1/5), ``grid`` points over [min - cut*bw,
    max + cut*bw].

    Values are first reduced to (value, count). A task then adds the kernels of its
    values up in one array of ``grid`` cells a group, so what is shuffled does not
    grow with the values: ``grid`` numbers a task and group.
    """
    v = df.where(F.col(value).isNotNull())
    h = v.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    st = v.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_sd"),
                              F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    st = st.withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    st = st.withColumns({"_lo": F.col("_mn") - float(cut) * F.col("_bw"),
                         "_hi": F.col("_mx") + float(cut) * F.col("_bw")})
    j = join_groups(h, st, [group])  # one stats row per group

    def sums(batches):
        cells: dict = {}
        for batch in batches:
            for g in batch[group].unique():
                own = batch[batch[group].isna() if g is None or g != g else batch[group] == g]
                n, bw, lo, hi = (own[c].iloc[0] for c in ("_n", "_bw", "_lo", "_hi"))
                if bw is None or not bw > 0:       # a single value has no density
                    continue
                x = lo + np.arange(grid) * ((hi - lo) / float(grid - 1))
                x[-1] = hi
                key = None if g is None or g != g else g
                total = cells.setdefault(key, (x, np.zeros(grid), n, bw))[1]
                values, counts = own[value].to_numpy(float), own["_c"].to_numpy(float)
                for at in range(0, len(values), 4096):
                    z = (x[None, :] - values[at:at + 4096, None]) / bw
                    total += counts[at:at + 4096] @ np.exp(-0.5 * z * z)
        for g, (x, total, n, bw) in cells.items():
            yield pd.DataFrame({"_g": [g] * grid, "i": np.arange(grid, dtype=np.int32), "x": x,
                                "_s": total / (n * bw * math.sqrt(2 * math.pi))})

    kind = dict(df.dtypes)[group]
    parts = j.mapInPandas(sums, f"_g {kind}, i int, x double, _s double")
    return parts.groupBy("_g", "i").agg(F.first("x").alias("x"), F.sum("_s").alias("density")).select(
        F.col("_g").alias(group), "i", "x", "density")


def cross_counts(df: DataFrame, a: str, b: str, order: Sequence[str] | None = None) -> DataFrame:
    """Counts a x b. With ``order``, values of ``a`` not listed are dropped
    and ``sort_key`` gives their display position."""
    if order is None:
        return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    keyed = df.where(F.col(a).isin(*order))
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(a)).cast("int")
    return keyed.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).withColumn("sort_key", pos)


def churn_share(df: DataFrame, segment: str, target: str = "target") -> DataFrame:
    """Churners per segment and their share of all churners."""
    g = df.where(F.col(target) == 1).groupBy(segment).agg(F.count(F.lit(1)).alias("churners"))
    g = with_totals(g, g, {"_t": F.sum("churners")})
    return g.select(segment, "churners",
                    F.try_divide(F.col("churners").cast("double"), F.col("_t").cast("double")).alias("share"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation for every pair below the diagonal, one aggregate
    pass (pairwise-complete: a row is skipped when either side is NULL)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_p{k}")
            for k, (a, b) in enumerate(pairs)]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{a}', '{b}', _p{k}" for k, (a, b) in enumerate(pairs))
    long = wide.selectExpr(f"stack({len(pairs)}, {parts}) AS (col_a, col_b, corr)")
    return long.select("col_a", "col_b", F.col("corr").alias("corr"))


def mean_bootstrap_ci(df: DataFrame, value: str, group: str, replicates: int = 1000, seed: int = 42,
                      level: float = 0.95) -> DataFrame:
    """Bootstrap interval of the group mean by Poisson resampling.

    Each (group, value) cell of the histogram gets a Poisson(count) weight per
    replicate (the sum of a Poisson(1) weight a row). Draws come from a counter
    (``draws``): a function of the cell and the replicate, computed for blocks of
    cells at once and independent of the layout. A task adds its cells up and emits
    ``replicates`` rows per group; the replicate means are a grouped aggregate and
    the interval is a percentile over ``replicates`` rows per group.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    h = h.select(group, F.col(value).cast("double").alias("_v"), "_c", F.xxhash64(
        F.col(group).cast("string"), F.col(value).cast("string"), F.lit(seed)).alias("_seed"))
    B = int(replicates)

    def draw(batches):
        # sums of weights and of weighted values for each group of the task and replicate
        sums: dict = {}
        for batch in batches:
            groups, names = pd.factorize(batch[group], use_na_sentinel=False)
            for k, name in enumerate(names):
                rows = np.flatnonzero(groups == k)
                own = sums.setdefault(None if name is None or name != name else name, np.zeros((2, B)))
                for at in range(0, len(rows), 1024):
                    block = batch.iloc[rows[at:at + 1024]]
                    w = poisson(block["_c"].to_numpy(), block["_seed"].to_numpy(), B)
                    own[0] += w.sum(axis=0)
                    own[1] += block["_v"].to_numpy() @ w
        for g, (w, wv) in sums.items():
            yield pd.DataFrame({"g": [g] * B, "b": np.arange(B, dtype=np.int32), "w": w.astype(np.int64), "wv": wv})

    schema = f"g {dict(df.dtypes)[group]}, b int, w long, wv double"
    reps = h.mapInPandas(draw, schema).groupBy("g", "b").agg(
        F.try_divide(F.sum("wv"), F.sum("w").cast("double")).alias("m"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    ci = reps.groupBy(F.col("g").alias(group)).agg(F.percentile("m", F.array(F.lit(lo), F.lit(hi))).alias("_q"))
    means = df.groupBy(group).agg(F.avg(value).alias("mean"))
    return same_keys_join(means, ci, [group]).select(
        group, F.col("mean").alias("mean"), F.col("_q")[0].alias("ci_lo"),
        F.col("_q")[1].alias("ci_hi"))
