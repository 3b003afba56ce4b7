"""Shared building blocks.

H — score histogram: ``groupBy(score)`` with counts / label sums. Every
threshold metric is a function of it; partial aggregation makes it safe
under a hot score (one value holding a third of the rows).

R — distributed running sums. A global ``Window.orderBy`` without
``partitionBy`` moves every row to one task; instead:

1. rows are cut into *buckets* that are contiguous ranges of the order
   (approximate quantiles of the values, or a prefix of a hash);
2. per-bucket totals (at most ``BUCKETS`` rows per group) get a running sum
   — a small table;
3. those offsets are joined back, and a window partitioned by bucket adds
   the within-bucket running sum.

Raw rows with ties are dealt by range of the total order ``(score, md5(id),
id)``, so a hot score is split like any other range: one shuffle, running sums in
the order of each part, and a small table of what the parts before hold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

UNBOUNDED = Window.unboundedPreceding
CURRENT = Window.currentRow


def valid(df: DataFrame, score: str) -> Column:
    """Whether a row's score counts: NULL and NaN are no scores. One rule for
    curves, bins, thresholds, calibration, gains and campaign tables."""
    c = F.col(score)
    return c.isNotNull() & ~F.isnan(c) if dict(df.dtypes)[score] in ("double", "float") else c.isNotNull()


# ----------------------------------------------------------------- H

def score_histogram(df: DataFrame, score: str = "score", label: str | None = "label",
                    value: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, distinct score): n, pos, neg[, val].

    Rows without a valid score are left out here and in every other operator that
    reads scores (see ``valid``)."""
    df = df.where(valid(df, score))
    aggs = [F.count(F.lit(1)).alias("n")]
    if label is not None:
        aggs.append(F.sum(F.col(label).cast("long")).alias("pos"))
    if value is not None:
        aggs.append(F.sum(F.col(value)).alias("val"))
    h = df.groupBy(*by, score).agg(*aggs)
    if label is not None:
        h = h.withColumn("neg", F.col("n") - F.col("pos"))
    return h


# ----------------------------------------------------------------- buckets

BUCKET_ROWS = 5_000      # rows of one range bucket, as long as there are at most
BUCKETS = 1 << 16        # this many buckets (a list of cut points on the driver)


def quantile_buckets(df: DataFrame, col: str, bucket_rows: int = BUCKET_ROWS,
                     out: str = "_b") -> DataFrame:
    """Range buckets of about ``bucket_rows`` rows for any numeric column.

    Runs a count and, for more than one bucket, a pass that computes the cut points
    (at most ``BUCKETS`` numbers reach the driver); ``df`` should be materialised.
    Assignment is a JVM binary search (``Bucketizer``).
    """
    bins = min(BUCKETS, df.count() // bucket_rows + 1)
    if bins == 1:
        return df.withColumn(out, F.lit(0).cast("long"))
    cuts = df.approxQuantile(col, [i / bins for i in range(1, bins)], 0.25 / bins)
    splits = sorted({float(c) for c in cuts if c is not None})
    splits = [float("-inf")] + splits + [float("inf")]
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out).cast("long"))


# ----------------------------------------------------------------- R

def _ordered(cols: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in cols]


def prefix_sums(df: DataFrame, order: Sequence[tuple[str, bool]], sums: Sequence[str],
                by: Sequence[str] = (), bucket: Column | str = "quantile",
                prefix: str = "cum_", ready: bool = False) -> DataFrame:
    """Inclusive running sums of ``sums`` over rows that are unique per
    (by, order). ``bucket`` is a Column that is monotone in the first order
    column, or ``"quantile"``: then ``df`` is materialised (a job; not if it is ``ready``,
    which says that it is materialised) and cut by its own quantiles, so any range of
    values is spread evenly. A NULL group is a group like any other.
    """
    first, first_asc = order[0]
    if isinstance(bucket, str):
        if bucket != "quantile":
            raise ValueError(bucket)
        g = quantile_buckets(df if ready else materialize(df), first)
    else:
        g = df.withColumn("_b", bucket)

    totals = g.groupBy(*by, "_b").agg(*[F.sum(s).alias(s) for s in sums])
    wb = (Window.partitionBy(*by).orderBy(F.col("_b").asc() if first_asc else F.col("_b").desc())
          .rowsBetween(UNBOUNDED, -1))
    offsets = totals.select(
        *by, "_b", *[F.coalesce(F.sum(s).over(wb), F.lit(0)).alias(f"_off_{s}") for s in sums])
    g = same_keys_join(g, offsets, [*by, "_b"])
    w = Window.partitionBy(*by, "_b").orderBy(*_ordered(order)).rowsBetween(UNBOUNDED, CURRENT)
    cums = {f"{prefix}{s}": F.sum(s).over(w) + F.col(f"_off_{s}") for s in sums}
    return g.withColumns(cums).drop("_b", *[f"_off_{s}" for s in sums])


def running_rows(df: DataFrame, *, order: str, id_col: str, values: Sequence[str] = (),
                 ascending: bool = False, by: Sequence[str] = (), prefix: str = "cum_") -> DataFrame:
    """Per-row position and running sums in the order (order, md5(id), id).

    Adds ``pos`` (1-based position within ``by``) and ``cum_<v>`` for each value
    (inclusive; a NULL adds nothing). Rows move once, by range of (by, order, md5(id),
    id), and are materialised (a job); each task sums in the order of its own rows, and
    what the parts before hold comes from a table of a row a part and group.
    """
    keys = [*[F.col(b).asc_nulls_first() for b in by], _ordered([(order, ascending)])[0], F.col("_tie"), F.col(id_col)]
    dealt = df.withColumn("_tie", F.md5(F.col(id_col).cast("string"))).repartitionByRange(*keys) \
        .sortWithinPartitions(*keys).drop("_tie").withColumn("_part", F.spark_partition_id())
    whole = {v: isinstance(df.schema[v].dataType, T.IntegralType) for v in values}
    schema = T.StructType([*dealt.schema.fields, T.StructField("_pos", T.LongType()), *[
        T.StructField(f"_c_{v}", T.LongType() if whole[v] else T.DoubleType()) for v in values]])
    names = [f.name for f in schema.fields]

    def run(batches):
        last, held = None, [0] * (len(values) + 1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = list(zip(*(batch.column(b).to_pylist() for b in by))) if by else [()] * n
            edges = [i for i in range(n) if groups[i] != (groups[i - 1] if i else last)] if by else []
            cols = [np.ones(n, np.int64)] + [
                np.nan_to_num(batch.column(v).cast(pa.float64()).to_numpy(zero_copy_only=False)) if not whole[v]
                else batch.column(v).cast(pa.int64()).fill_null(0).to_numpy() for v in values]
            sums = [np.empty(n, c.dtype) for c in cols]
            cuts = sorted({0, *edges, n})
            for a, z in zip(cuts, cuts[1:]):
                if edges and a >= edges[0]:        # a group begins here
                    held = [0] * len(cols)
                for k, c in enumerate(cols):
                    sums[k][a:z] = np.cumsum(c[a:z]) + held[k]
                    held[k] = sums[k][z - 1]
            last = groups[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], names=names)

    placed = materialize(dealt.mapInArrow(run, schema))
    ends = placed.groupBy(*by, "_part").agg(F.max("_pos").alias("_o_pos"), *[
        F.max_by(f"_c_{v}", "_pos").alias(f"_o_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(UNBOUNDED, -1)
    starts = ends.select(*by, "_part", *[F.coalesce(F.sum(f"_o_{v}").over(before), F.lit(0)).alias(f"_o_{v}")
                                         for v in ("pos", *values)])
    out = join_groups(placed, starts, [*by, "_part"])
    return out.select(*df.columns, (F.col("_pos") + F.col("_o_pos")).alias("pos"),
                      *[(F.col(f"_c_{v}") + F.col(f"_o_{v}")).alias(f"{prefix}{v}") for v in values])


def with_totals(df: DataFrame, source: DataFrame, aggs: dict[str, Column],
                by: Sequence[str] = ()) -> DataFrame:
    """Attach group totals of ``source`` to ``df``.

    Without groups all totals are one scalar subquery (a struct, computed once;
    no join). With groups see ``join_groups``.
    """
    if not by:
        one = source.select(F.struct(*[a.alias(n) for n, a in aggs.items()]).alias("_t")).scalar()
        return df.withColumn("_t", one).select(*df.columns, *[F.col(f"_t.{n}").alias(n) for n in aggs])
    return join_groups(df, source.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]), by)


def same_keys_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, NULL being equal to NULL; columns of ``df`` and
    the rest of ``other``."""
    other = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(other, cond).drop(*[f"_k_{k}" for k in keys])


MAX_GROUPS = 100_000


def join_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], ready: bool = False) -> DataFrame:
    """``df`` with its row of ``groups`` (one row for each key; NULL is a key).

    The group table is materialised (unless it is ``ready``) and counted (a job): up to ``MAX_GROUPS``
    rows it is broadcast, so that no row of ``df`` moves and a hot key is no
    hot task; a larger one is joined by shuffle.
    """
    groups = groups if ready else materialize(groups)
    small = groups.count() <= MAX_GROUPS
    return same_keys_join(df, F.broadcast(groups) if small else groups, by)


def top_sums(df: DataFrame, *, order: str, id_col: str, values: Sequence[str],
             fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Sums of ``values`` over the first k = floor(n * p) rows in the order
    (order descending, md5(id), id), for every p of ``fractions``.

    Columns: by, i (index of p), p, k, top_<v>, all_<v>; 0 where k is 0. The
    histogram of ``order`` gives the value at which each top ends; only the
    rows tied on such a value are ranked. Rows without a valid value are left out.
    """
    src = df.where(valid(df, order)).select(*by, id_col, order, *values)
    h = materialize(src.groupBy(*by, order).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_g_{v}") for v in values]))
    sums = ["_n", *[f"_g_{v}" for v in values]]
    c = with_totals(prefix_sums(h, [(order, False)], sums, by=by, ready=True), h,
                    {"_T": F.sum("_n"), **{f"all_{v}": F.sum(f"_g_{v}") for v in values}}, by)
    wanted = F.transform(F.array(*[F.lit(float(p)) for p in fractions]), lambda p, i: F.struct(
        i.alias("i"), p.alias("p"), F.floor(F.col("_T") * p).alias("k")))
    before = F.col("cum__n") - F.col("_n")
    # the row where a top ends; a top without rows ends at the first row
    ends = F.filter(wanted, lambda w: ((before < w["k"]) & (w["k"] <= F.col("cum__n")))
                    | ((w["k"] == 0) & (before == 0)))
    cuts = materialize(c.select(*by, order, F.explode(ends).alias("w"), (F.col("w.k") - before).alias("_need"),
                                *[f"all_{v}" for v in values],
                                *[F.when(F.col("w.k") > 0, F.col(f"cum__g_{v}") - F.col(f"_g_{v}")).otherwise(
                                    F.lit(0)).alias(f"_b_{v}") for v in values])
                       .select("*", "w.i", "w.p", "w.k").drop("w"))
    tied = join_groups(src, cuts, [*by, order], ready=True).withColumns({
        "_one": F.lit(1), "_tie": F.md5(F.col(id_col).cast("string"))})
    ranked = prefix_sums(tied, [("_tie", True), (id_col, True)], ["_one"], by=[*by, "i"],
                         bucket=hex_bucket("_tie"))
    inside = F.col("cum__one") <= F.col("_need")
    return ranked.groupBy(*by, "i").agg(
        F.first("p").alias("p"), F.first("k").alias("k"),
        *[(F.first(f"_b_{v}") + F.coalesce(F.sum(F.when(inside, F.col(v))), F.lit(0))).alias(f"top_{v}")
          for v in values], *[F.first(f"all_{v}").alias(f"all_{v}") for v in values])


# ----------------------------------------------------------------- hash order

def hash_order(id_col: str, seed: int = 42) -> Column:
    """Deterministic pseudo-random order key: md5 of 'seed|id' (hex)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def hash_order_sql(id_col: str, seed: int = 42) -> str:
    return f"md5('{seed}' || '|' || CAST({id_col} AS VARCHAR))"


def hex_bucket(col: str, digits: int = 4) -> Column:
    """Bucket of a hex-string order key by its leading digits (uniform)."""
    return F.conv(F.substring(col, 1, digits), 16, 10).cast("long")


# ----------------------------------------------------------------- quantiles

def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a small derived table (a histogram, a bucket table)
    that later passes read several times: a reliable checkpoint into the
    session's shared folder, written at once by a job. Operators that call
    this therefore run jobs while they are built."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    by: Sequence[str] = (), weight: str | None = None, ready: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles (the rule of ``percentile`` /
    ``quantile_cont``) without one task holding every value: a histogram of
    distinct values gets a distributed running count; each histogram row
    then picks, by a narrow array filter, the requested positions it covers.

    ``weight`` names a count column when ``df`` is already a histogram; one that is
    materialised and has a row a value is ``ready`` and read as it is. Returns (by..., pi, p, q).
    """
    cnt = F.count(F.lit(1)) if weight is None else F.sum(weight)
    h = df.where(F.col(col).isNotNull())
    h = h.select(*by, col, F.col(weight).alias("_n")) if ready else materialize(
        h.groupBy(*by, col).agg(cnt.alias("_n")))
    h = with_totals(prefix_sums(h, [(col, True)], ["_n"], by=by, ready=True), h, {"_tot": F.sum("_n")}, by)
    plist = F.array(*[F.lit(float(p)) for p in probs])
    # positions needed: floor and ceil of (N - 1) * p, tagged with the index
    need = F.transform(plist, lambda p, i: F.struct(
        i.alias("pi"), p.alias("p"), ((F.col("_tot") - 1) * p).alias("h")))
    hits = F.filter(F.transform(need, lambda s: F.struct(
        s["pi"].alias("pi"), s["p"].alias("p"), s["h"].alias("h"),
        F.floor(s["h"]).alias("lo"), F.ceil(s["h"]).alias("hi"))),
        lambda s: ((F.col("cum__n") - F.col("_n") <= s["lo"]) & (s["lo"] < F.col("cum__n")))
        | ((F.col("cum__n") - F.col("_n") <= s["hi"]) & (s["hi"] < F.col("cum__n"))))
    a = F.col("cum__n") - F.col("_n")
    x = (h.select(*by, F.col(col).alias("_v"), a.alias("_a"), F.col("cum__n").alias("_z"),
                  F.explode(hits).alias("s"))
         .select(*by, "s.pi", "s.p", "s.h",
                 F.when((F.col("_a") <= F.col("s.lo")) & (F.col("s.lo") < F.col("_z")),
                        F.col("_v")).alias("lo_v"),
                 F.when((F.col("_a") <= F.col("s.hi")) & (F.col("s.hi") < F.col("_z")),
                        F.col("_v")).alias("hi_v"),
                 F.col("s.lo").alias("lo")))
    r = x.groupBy(*by, "pi", "p").agg(F.max("h").alias("h"), F.max("lo").alias("lo"),
                                      F.max("lo_v").alias("lo_v"), F.max("hi_v").alias("hi_v"))
    q = F.col("lo_v") + (F.col("h") - F.col("lo")) * (F.col("hi_v") - F.col("lo_v"))
    return r.select(*by, "pi", "p", q.alias("q"))
