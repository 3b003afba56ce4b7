"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than these, as the contracts state.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A private folder is made only for a local master that names none; a
    cluster without one is an error, as executors cannot share local disks.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="attrition-llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir() or where


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder; runs a job at once.

    Spark's context cleaner removes the files when the frame is no longer
    referenced if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words, as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the fast byte-wise path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


ARROW_ROWS = 2_000        # rows of one Arrow batch with whole texts


def small_batches(spark: SparkSession) -> None:
    """At most ``ARROW_ROWS`` rows an Arrow batch in this session, fewer if it says so
    already: the JVM and its Python worker each hold a batch of texts outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


SIEVE_WORDS = 1 << 17     # 64-bit words of a sieve: 2 MB with their numbers, whatever is in it


def sieved(df: DataFrame, id_col: str, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with ``__maybe``: true for all rows whose id is in ``ids.column`` and
    for few others.

    It keeps rows without a partner out of a shuffle before an exact join. The
    bitmap, which is broadcast, has at most ``SIEVE_WORDS`` rows; with very many ids it
    lets more pass, never fewer.
    """
    mask = SIEVE_WORDS - 1
    words = ids.selectExpr(f"xxhash64(`{column}`) AS h").selectExpr(
        f"shiftright(h, 6) & {mask} AS __word", "shiftleft(1L, int(h & 63)) AS bit").groupBy("__word").agg(
        F.bit_or("bit").alias("__bits"))
    rows = df.withColumn("__hash", F.xxhash64(id_col))
    found = rows.join(F.broadcast(words), F.expr(f"shiftright(__hash, 6) & {mask}") == F.col("__word"), "left")
    return found.select(*[df[c] for c in df.columns], F.coalesce(
        F.expr("shiftright(__bits, int(__hash & 63)) & 1L") == 1, F.lit(False)).alias("__maybe"))
