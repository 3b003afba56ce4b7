"""Sources and sinks: raw table, database extract, Parquet / CSV / JSON
tables, serving parameters and the fitted pipeline.

Every reader takes an explicit schema (no inference pass over the data).
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import PARAMS, RAW


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet",
             schema: T.StructType = RAW, **options) -> DataFrame:
    """Read the raw subscriber table with its declared schema."""
    r = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    return r.options(**options).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, *, query: str | None = None,
              partition: Mapping | None = None, options: Mapping | None = None) -> DataFrame:
    """Extract a table or query through JDBC.

    ``partition`` = {column, lowerBound, upperBound, numPartitions} splits
    the read into parallel range queries (needs ``table``). Credentials are
    passed in ``options`` (user / password), never written into code.
    """
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    r = spark.read.format("jdbc").option("url", url)
    r = r.option("dbtable", table) if table is not None else r.option("query", query)
    if partition:
        if table is None:
            raise ValueError("partitioned reads need a table")
        r = (r.option("partitionColumn", partition["column"])
             .option("lowerBound", str(partition["lowerBound"]))
             .option("upperBound", str(partition["upperBound"]))
             .option("numPartitions", str(partition["numPartitions"])))
    return r.options(**dict(options or {})).load()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: tuple[str, ...] = (), **options) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.options(**options).save(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               **options) -> DataFrame:
    r = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    return r.options(**options).load(path)


def params_frame(spark: SparkSession, params: Mapping) -> DataFrame:
    """Serving parameters as a one-row DataFrame of the PARAMS schema."""
    row = tuple(params.get(f.name) for f in PARAMS.fields)
    return spark.createDataFrame([row], PARAMS)


def write_params(df: DataFrame, path: str) -> None:
    """One-row parameter / metric frame -> JSON (single file)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str, schema: T.StructType = PARAMS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def params_dict(df: DataFrame) -> dict:
    """A one-row parameter frame as a dict (bounded: one row)."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected exactly one parameter row")
    return json.loads(json.dumps(rows[0].asDict(recursive=True)))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def round_trip(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """Write then read back with the same schema (used by the source checks)."""
    write_table(df, path, fmt)
    return read_table(df.sparkSession, path, df.schema, fmt)
