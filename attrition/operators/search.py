"""Random search with a ledger.

A search is ``n_iter`` candidates times the folds. Each fit writes its F1 as a row of
a table in the shared folder at once; a later session, or a second one beside it, skips
the rows that are there. So a search of days needs no session that lasts as long, a lost
driver loses one fit, and ranks and best settings are read from the table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import bins_for, build_pipeline, fit_boosted, fixed_layout, prepare_label, sample_params

ROWS = "search string, candidate int, fold int, f1 double, rows long, params string"


class SearchLedger:
    """Cross-validated random search over ``train``, kept at ``path``.

    ``search`` names what a row belongs to: a digest of the settings and of the training
    rows (ids, folds, labels), so that one path may hold several searches and rows of
    other data are never taken for finished ones.
    """

    def __init__(self, train: DataFrame, path: str, cat_cols: Sequence[str], num_cols: Sequence[str], *,
                 id_col: str, fold_col: str = "fold", n_iter: int = 80, seed: int = 42,
                 ranges: Mapping | None = None, weight_col: str | None = "weight", label_col: str = "target"):
        self.spark: SparkSession = train.sparkSession
        self.path, self.cat_cols, self.num_cols = path, list(cat_cols), list(num_cols)
        self.weight_col, self.label_col, self.fold_col, self.id_col = weight_col, label_col, fold_col, id_col
        self.candidates = sample_params(n_iter, seed, ranges)
        self.train = fixed_layout(prepare_label(train, label_col), id_col)
        digest = self.train.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64(id_col, fold_col, label_col)),
            F.sum(F.xxhash64(id_col, fold_col, label_col, F.lit(1)).cast("decimal(38,0)"))).first()
        self.folds = [r[0] for r in self.train.select(fold_col).distinct().orderBy(fold_col).collect()]
        what = [self.candidates, list(map(str, digest)), self.folds, self.cat_cols, self.num_cols, weight_col]
        self.search = hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()[:16]
        self.bins = bins_for(self.train, self.cat_cols)

    def done(self) -> DataFrame:
        """The finished fits of this search. A fit that two sessions made counts once."""
        try:
            table = self.spark.read.schema(ROWS).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            table = self.spark.createDataFrame([], ROWS)
        return table.where(F.col("search") == self.search).dropDuplicates(["candidate", "fold"])

    def open(self) -> list[tuple[int, int]]:
        """(candidate, fold) pairs that are to be fitted, in order."""
        there = {(r["candidate"], r["fold"]) for r in self.done().select("candidate", "fold").collect()}
        return [(c, k) for c in range(len(self.candidates)) for k in self.folds if (c, k) not in there]

    def fit_one(self, candidate: int, fold: int) -> float:
        """F1 of the positive class on ``fold`` of a fit on the other folds."""
        rest = self.train.where(F.col(self.fold_col) != fold)
        params = {"maxBins": self.bins, **self.candidates[candidate]}
        model = build_pipeline(self.cat_cols, self.num_cols, params, self.weight_col, self.label_col).fit(rest)
        held = model.transform(self.train.where(F.col(self.fold_col) == fold))
        y, p = F.col(self.label_col) == 1, F.col("prediction") == 1
        c = held.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")).first()
        return 2 * c["tp"] / (2 * c["tp"] + c["fp"] + c["fn"]) if c["tp"] else 0.0

    def run(self, most: int | None = None) -> int:
        """Fit what is open, at most ``most`` pairs in this session; how many stay open."""
        todo = self.open()
        for candidate, fold in todo[:most]:
            f1 = self.fit_one(candidate, fold)
            row = (self.search, candidate, fold, float(f1), self.train.count(),
                   json.dumps(self.candidates[candidate], sort_keys=True))
            self.spark.createDataFrame([row], ROWS).coalesce(1).write.mode("append").parquet(self.path)
        return max(0, len(todo) - (len(todo) if most is None else most))

    def results(self) -> DataFrame:
        """(candidate, params, folds, mean_f1, std_f1, rank) of the candidates of which all
        folds are there; the best mean has rank 1, equal ones share a rank."""
        full = self.done().groupBy("candidate").agg(
            F.first("params").alias("params"), F.count(F.lit(1)).cast("int").alias("folds"), F.avg("f1").alias("mean_f1"),
            F.stddev_pop("f1").alias("std_f1")).where(F.col("folds") == len(self.folds))
        return full.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_f1"))))  # a row a candidate

    def best(self) -> tuple[dict, float]:
        """Settings and mean F1 of the best candidate (ties: the first); only of a search
        that is complete."""
        left = len(self.open())
        if left:
            raise ValueError(f"{left} of {len(self.candidates) * len(self.folds)} fits are open")
        r = self.results().orderBy("rank", "candidate").first()
        return json.loads(r["params"]), r["mean_f1"]

    def refit(self) -> PipelineModel:
        """The best candidate fitted on all folds."""
        return fit_boosted(self.train, self.cat_cols, self.num_cols, self.best()[0], self.weight_col, self.label_col)
