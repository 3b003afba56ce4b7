"""Deterministic stratified splitting and folds.

Rows are ordered inside each class by ``md5('seed|id')`` — the same in Spark
and SQL, and independent of partitioning. ``exact`` takes the first
ceil(n_c * f) rows of each class through the distributed running count;
``hash`` thresholds the hash itself (narrow, no shuffle, approximate sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .primitives import hash_order, hex_bucket, join_groups, prefix_sums, with_totals


def _ranked(df: DataFrame, id_col: str, target: str, seed: int) -> DataFrame:
    """Adds pos, the position in the class's hash order, and _n, the class's size.
    A NULL class is a class like any other. Bucket counts, one shuffle of the rows by
    (class, hash bucket); class sizes are broadcast."""
    src = df.withColumns({"_h": hash_order(id_col, seed), "_one": F.lit(1)})
    r = prefix_sums(src, [("_h", True), (id_col, True)], ["_one"], by=[target], bucket=hex_bucket("_h", 4))
    sizes = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    return join_groups(r.withColumnRenamed("cum__one", "pos").drop("_one"), sizes, [target])


def stratified_split(df: DataFrame, *, id_col: str, target: str, test: float = 0.20,
                     val: float = 0.25, seed: int = 42, mode: str = "exact",
                     out: str = "split") -> DataFrame:
    """Test share ``test``, then ``val`` of the remainder, per class.

    exact: per class, the first ceil(n * test) rows in hash order are test,
    the next ceil((n - that) * val) are validation, the rest train.
    """
    if mode == "hash":
        u = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("double") / float(16 ** 8)
        cut_val = test + (1.0 - test) * val
        return df.withColumn(out, F.when(u < test, "test").when(u < cut_val, "val").otherwise("train"))
    r = _ranked(df, id_col, target, seed)
    kt = F.ceil(F.col("_n") * F.lit(float(test)))
    kv = kt + F.ceil((F.col("_n") - kt) * F.lit(float(val)))
    lab = F.when(F.col("pos") <= kt, "test").when(F.col("pos") <= kv, "val").otherwise("train")
    return r.withColumn(out, lab).drop("_h", "_n", "pos")


def stratified_folds(df: DataFrame, *, id_col: str, target: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """Fold = (position in class hash order - 1) mod k: class-balanced."""
    r = _ranked(df, id_col, target, seed)
    return r.withColumn(out, F.pmod(F.col("pos") - 1, F.lit(k)).cast("int")).drop("_h", "_n", "pos")


def class_weight(df: DataFrame, *, target: str, out: str = "weight") -> DataFrame:
    """weight = neg / pos for positives (1.0 when there is no positive),
    1.0 for negatives."""
    spw = F.coalesce(F.try_divide(F.col("_neg").cast("double"), F.col("_pos").cast("double")), F.lit(1.0))
    t = with_totals(df, df, {"_pos": F.count_if(F.col(target) == 1),
                             "_neg": F.count_if(F.col(target) == 0)})
    return t.withColumn(out, F.when(F.col(target) == 1, spw).otherwise(F.lit(1.0))).drop("_pos", "_neg")


def class_weight_summary(df: DataFrame, *, target: str) -> DataFrame:
    k = df.agg(F.count_if(F.col(target) == 0).alias("neg"), F.count_if(F.col(target) == 1).alias("pos"))
    return k.withColumn("scale_pos_weight", F.coalesce(
        F.try_divide(F.col("neg").cast("double"), F.col("pos").cast("double")), F.lit(1.0)))
