"""Encoding, assembly and boosted-tree fitting with Spark ML.

The fitted ``PipelineModel`` carries the category vocabulary (a fitted
``StringIndexerModel``), so a one-row batch scores exactly like the same
row inside a large batch; unseen categories map to the extra index.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .primitives import MAX_GROUPS, join_groups, materialize, with_totals

# Tuned booster settings and their Spark counterparts.
BOOSTED_PARAMS = {
    "maxIter": 100,
    "stepSize": 0.1,
    "maxDepth": 3,
    "subsamplingRate": 0.6,
    "featureSubsetStrategy": "0.62",
    "minInstancesPerNode": 1,
    "seed": 42,
}

# Random-search ranges (low inclusive, high exclusive for ints).
SEARCH_RANGES = {
    "maxIter": (200, 1200),
    "maxDepth": (2, 8),
    "stepSize": (0.01, 0.20),
    "subsamplingRate": (0.6, 1.0),
    "featureSubsetStrategy": (0.6, 1.0),
    "minWeightFractionPerNode": (0.0, 0.05),
    "minInfoGain": (0.0, 5.0),
}


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """String columns, in table order (the auto-detect rule)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]


def vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, value, code): dense codes from 0 in the order of the values, which
    are never gathered: distinct values are dealt by range, numbered inside their part and
    moved by the sizes of the parts before (a table of a row a part and column)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    values = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (variable, value)").where("value IS NOT NULL").distinct()
    placed = materialize(values.repartitionByRange("variable", "value").withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("variable", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("variable").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("variable", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("variable", "_part").orderBy("value"))
    return join_groups(placed.withColumn("_rank", rank), starts, ["variable", "_part"]).select(
        "variable", "value", (F.col("_rank") - 1 + F.col("_start")).cast("int").alias("code"))


def categorical_encode(df: DataFrame, vocab: DataFrame, cols: Sequence[str], suffix: str = "_idx") -> DataFrame:
    """``df`` with the code of every column of ``cols``; a NULL or a value that the
    vocabulary lacks gets the number of its values. Each column's vocabulary is
    broadcast if it has at most ``MAX_GROUPS`` values and else joined by shuffle."""
    vocab = materialize(vocab)
    sizes = {r["variable"]: r["n"] for r in vocab.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for c in cols:
        own = vocab.where(F.col("variable") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        own = F.broadcast(own) if sizes.get(c, 0) <= MAX_GROUPS else own
        out = out.join(own, F.col(c).cast("string") == F.col("_v"), "left").drop("_v").withColumn(
            c + suffix, F.coalesce("_code", F.lit(sizes.get(c, 0)))).drop("_code")
    return out


def categorical_encoder(cat_cols: Sequence[str], suffix: str = "_idx") -> StringIndexer:
    return StringIndexer(inputCols=list(cat_cols), outputCols=[c + suffix for c in cat_cols],
                         handleInvalid="keep", stringOrderType="alphabetAsc")


def build_pipeline(cat_cols: Sequence[str], num_cols: Sequence[str], params: Mapping | None = None,
                   weight_col: str | None = None, label_col: str = "target",
                   features_col: str = "features") -> Pipeline:
    """StringIndexer -> Imputer(median) -> VectorAssembler -> GBTClassifier.

    Node ids are not cached: walking a tree of a few levels costs less than a cached
    column of ids a level, and the trees are the same."""
    idx = categorical_encoder(cat_cols)
    imp_out = [c + "_imp" for c in num_cols]
    imputer = Imputer(inputCols=list(num_cols), outputCols=imp_out, strategy="median")
    asm = VectorAssembler(inputCols=imp_out + [c + "_idx" for c in cat_cols], outputCol=features_col,
                          handleInvalid="keep")
    p = dict(BOOSTED_PARAMS)
    p.update(params or {})
    p.setdefault("maxBins", MIN_BINS)
    gbt = GBTClassifier(featuresCol=features_col, labelCol=label_col, cacheNodeIds=False,
                        checkpointInterval=10, **p)
    if weight_col:
        gbt.setWeightCol(weight_col)
    return Pipeline(stages=[idx, imputer, asm, gbt])


def prepare_label(df: DataFrame, label_col: str = "target") -> DataFrame:
    if label_col not in df.columns:
        raise ValueError(f"target column '{label_col}' is missing")
    return df.withColumn(label_col, F.col(label_col).cast("double"))


MIN_BINS = 64  # of numeric features; a column with more categories has as many


def bins_for(train: DataFrame, cat_cols: Sequence[str]) -> int:
    """Bins that the largest vocabulary needs, the index of unseen values included."""
    if not cat_cols:
        return MIN_BINS
    sizes = train.agg(*[F.countDistinct(c).alias(c) for c in cat_cols]).first()
    return max(MIN_BINS, *(n + 1 for n in sizes))


def fixed_layout(train: DataFrame, id_col: str, rows_per_part: int = 50_000) -> DataFrame:
    """The same rows, written once, in a layout that follows from the ids alone:
    parts by hash, sorted by id. Subsampling draws by part and place, so without
    this a fit would depend on how its input happened to be partitioned. Every level of
    every tree is a pass over the parts, so there are enough of them to keep the cores busy."""
    train = materialize(train)
    parts = max(1, -(-train.count() // rows_per_part))
    return materialize(train.repartition(parts, F.col(id_col)).sortWithinPartitions(id_col))


def fit_boosted(train: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str],
                params: Mapping | None = None, weight_col: str | None = "weight",
                label_col: str = "target", id_col: str | None = None) -> PipelineModel:
    """Fit the booster. With ``id_col`` the model depends on the rows alone, not on
    their layout (see ``fixed_layout``)."""
    train = prepare_label(train, label_col)
    if id_col is not None:
        train = fixed_layout(train, id_col)
    params = {"maxBins": bins_for(train, cat_cols), **dict(params or {})}
    return build_pipeline(cat_cols, num_cols, params, weight_col, label_col).fit(train)


def feature_names(model: PipelineModel) -> list[str]:
    asm = [s for s in model.stages if isinstance(s, VectorAssembler)][0]
    names = []
    for c in asm.getInputCols():
        for suf in ("_imp", "_idx"):
            if c.endswith(suf):
                c = c[: -len(suf)]
        names.append(c)
    return names


def tree_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved booster's nodes as rows: tree, node, left, right (-1 in leaves),
    feature (-1 in leaves), gain, cover (weight of the rows that reach it), prediction,
    weight (of the tree)."""
    stages = spark.read.json(f"{path}/stages/*/metadata").select(
        F.input_file_name().alias("file"), "class").where(F.col("class").contains("GBT")).collect()
    stage = stages[0]["file"].split("/metadata/")[0]
    nodes = spark.read.parquet(f"{stage}/data")
    trees = spark.read.parquet(f"{stage}/treesMetadata").toDF("treeID", "settings", "weight").drop("settings")
    n = F.col("nodeData")
    return nodes.join(trees, "treeID").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), n["gain"].alias("gain"),
        n["impurityStats"][0].alias("cover"), n["prediction"].alias("prediction"), "weight")


def feature_importance(spark: SparkSession, path: str, names: Sequence[str], top: int | None = 10) -> DataFrame:
    """(feature, importance, rank) of a saved booster, from its table of nodes: the
    gain of each split times the weight of its rows, added up by feature and
    normalised to 1. Features that no tree splits on have 0."""
    gains = tree_table(spark, path).where("left >= 0").groupBy("feature").agg(
        F.sum(F.col("gain") * F.col("cover")).alias("_g"))
    every = spark.createDataFrame(list(enumerate(names)), "_i int, name string")
    g = every.join(gains, F.col("_i") == F.col("feature"), "left").select(
        F.col("name").alias("feature"), F.coalesce("_g", F.lit(0.0)).alias("_g"))
    g = with_totals(g, g, {"_t": F.sum("_g")}).select(
        "feature", F.coalesce(F.try_divide(F.col("_g"), F.col("_t")), F.lit(0.0)).alias("importance"))
    # a row a feature
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    g = g.withColumn("rank", rank)
    return g if top is None else g.where(F.col("rank") <= top)


def sample_params(n_iter: int, seed: int = 42, ranges: Mapping | None = None) -> list[dict]:
    """Seeded random draws over the search ranges, one dict of settings a candidate."""
    rng = random.Random(seed)
    rr = dict(SEARCH_RANGES) | dict(ranges or {})
    out = []
    for _ in range(n_iter):
        own = {}
        for name, (lo, hi) in rr.items():
            whole = isinstance(lo, int) and isinstance(hi, int)
            v = rng.randrange(lo, hi) if whole else rng.uniform(lo, hi)
            own[name] = f"{v:.2f}" if name == "featureSubsetStrategy" else v
        out.append(own)
    return out
