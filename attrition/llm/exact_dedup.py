"""Exact dedup by skew-safe combining.

Texts are compared after lower-casing A-Z only. Duplicates are combined in
three steps, each of which has the whole text among its grouping keys, so that
only identical content ever merges:

1. in each task, by Spark's map-side aggregation;
2. per (digest, salt, text): a hot text is spread over ``salts`` reducers;
3. per (digest, text) over the winners of the salts, at most ``salts`` rows a text.

The rows then find their group by digest. That is exact whenever a digest
belongs to one text, which step 3 shows; rows of a digest with several texts
(a collision) are joined by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, checkpointed, read_table

SALTS = 16
OUT = ["doc_id", "keep_id", "group_size", "text_sha256"]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, id_col: str, text_col: str, salts: int,
          digest: Callable[[Column], Column]) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    return rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     salts: int = SALTS,
                     digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of a group stays. A null text counts as empty;
    the empty text is a text like any other. A row with a null id stays only if
    all ids of its group are null; of rows that repeat the largest id all are
    marked kept (``drop_duplicates`` returns one of them). Other columns are
    ignored. An empty table gives no rows. Runs a job when called: the groups,
    without their texts, are written to the shared folder.
    """
    rows = _rows(docs, id_col, text_col, salts, digest)
    by_salt = rows.groupBy("digest", "salt", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    texts = by_salt.groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    found = checkpointed(texts.select("digest", "keep_id", "group_size"))
    # each digest with its number of texts, spread over the salts; a text of
    # one row needs no partner unless its digest has several texts
    groups = found.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size")).where("n_texts > 1 OR group_size > 1")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    narrow = rows.select("doc_id", "digest", "salt", F.sha2("norm", 256).alias("text_sha256"))
    clash = groups.where("n_texts > 1").select("digest")
    joined = narrow.join(spread, ["digest", "salt"], "left")
    if not clash.isEmpty():
        full = rows.join(clash, "digest", "left_semi").join(texts, ["digest", "norm"])
        joined = joined.where("n_texts IS NULL OR n_texts = 1").select(*OUT).unionByName(
            full.withColumn("text_sha256", F.sha2("norm", 256)).select(*OUT))
    keep = F.coalesce("keep_id", "doc_id")
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, whole: one per text, with the largest id.

    Of rows that repeat this id and text one stays (the first by its other
    columns as JSON). Nulls and ties as in ``duplicate_groups``.
    """
    groups = duplicate_groups(docs, id_col, text_col, salts)
    keep = groups.where("kept").groupBy(_key(F.col("doc_id"), F.col("text_sha256")).alias("__key")).agg(
        F.count(F.lit(1)).alias("__copies"))
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.withColumn("__key", _key(F.col(id_col), F.sha2(norm, 256))).join(keep, "__key")
    order = F.when(F.col("__copies") > 1, F.to_json(F.struct(*docs.columns)))
    return rows.withColumn("__row", F.row_number().over(Window.partitionBy("__key").orderBy(order))).where(
        "__row = 1").select(*docs.columns)


def _key(row_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", sha, row_id.cast("string"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(read_table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
