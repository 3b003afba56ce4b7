"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order; the row of rank r among n of its
source has the fractional rank (r - 1/2) / n. Sorted by fractional rank, all
sources run through the whole order in proportion, so that equal cuts of it are
shards which match the mixture. Both ranks are found without a global window:
buckets are counted, their offsets summed, and rows ranked inside buckets.
Law: ``rows`` (the sizes of two shards differ by one row at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, read_table

SHARDS = 16
SEED = "shard-1"
BUCKET_ROWS = 500      # rows of a bucket, up to so many
BUCKETS = 65_536       # buckets; beyond that they grow, and are sorted on disk where needed


def _rank(rows: DataFrame, by: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Rank from 0 by (bucket, order) within ``by``; buckets are even by hash or by fraction."""
    counts = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order))
    ranked = rows.withColumn("_in", within)
    same = [ranked[c].eqNullSafe(offsets[c]) for c in [*by, bucket]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return ranked.join(offsets, on).select(
        *[ranked[c] for c in rows.columns], (F.col("_before") + F.col("_in") - 1).alias(name))


def interleave(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source", seed: str = SEED,
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, text_crc32, rank, shard, slot.

    ``size`` is the UTF-8 bytes of the text plus 1. A null text has no bytes; a
    null source is a source of its own. Rows that repeat an id are told apart by
    size and checksum; rows equal in these too may swap their places. Slots run
    from 0 without gaps in every shard. Empty tables give no rows; shards beyond
    the number of rows stay empty. Runs two jobs when called: the narrow rows
    (no text) are written to the shared folder after each ranking.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
                          ).cast("binary")).alias("_key")))
    sources = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"))
    n_rows = narrow.count()
    buckets = min(BUCKETS, max(1, -(-n_rows // bucket_rows)))
    hashed = narrow.withColumn("_b", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
                                      * F.lit(buckets) / F.lit(2 ** 32)).cast("long"))
    order = [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    own = _rank(hashed, ["source"], "_b", order, "_rank").drop("_b")
    placed = own.join(F.broadcast(sources) if sources.count() <= 10_000 else sources,
                      own["source"].eqNullSafe(sources["source"])).select(
        *[own[c] for c in own.columns], "_rows")
    # (2r + 1) / 2n in whole numbers: exact ties, and one bucket of width 1 / buckets
    spot = placed.withColumn("_part", (F.lit(2) * F.col("_rank") + 1) / (F.lit(2) * F.col("_rows")))
    spot = spot.withColumn("_b", F.floor(F.col("_part") * F.lit(buckets)))
    spot = checkpointed(spot.drop("_rows", "_rank"))
    mixed = _rank(spot.withColumn("_all", F.lit(0)), ["_all"], "_b",
                  [F.col("_part"), *order], "rank")
    # cut: the first (n mod shards) shards hold one row more
    least, more = divmod(n_rows, shards)
    edge = more * (least + 1)
    at = F.col("rank")
    shard = F.when(at < edge, F.floor(at / F.lit(least + 1))).otherwise(
        F.lit(more) + F.floor((at - edge) / F.lit(max(least, 1))))
    first = F.when(F.col("shard") < more, F.col("shard") * F.lit(least + 1)).otherwise(
        F.lit(edge) + (F.col("shard") - F.lit(more)) * F.lit(least))
    return mixed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "rank", "shard",
        (F.col("rank") - first).cast("long").alias("slot"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
