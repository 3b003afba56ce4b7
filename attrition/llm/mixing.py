"""Mixing sources to target weights.

Each source is cut into blocks by a hash of the document id, and its target
becomes a quota: all its blocks once for every whole time the target holds the
source, then whole blocks in a seeded order and, of one block, documents in a
seeded order until the quota of words is met, the last of them as far as the
quota goes. How many blocks of each source
go to which output shard is settled by a splitting tree: the vector of block
quotas is halved again and again by multivariate hypergeometric draws, so that
every shard is a fair draw from the mixture and all quotas are met exactly.
The blocks, in a second seeded order, are then dealt to the shards, and rows
are shuffled inside their shard by hash.

The tree needs one number for each source and shard; documents are only
counted, joined to their block and ordered inside it.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, checkpointed, n_words, read_table

WEIGHTS = (5, 2, 1)        # of the sources by name, repeating
SHARE = 1.5                # of all words that the mix holds
MOST = 2.0                 # times that a source is used at most
SHARDS = 16
SEED = "mix-1"
BLOCK_WORDS = 1 << 13      # words of a block, as long as a source has at most
BLOCKS = 1 << 16           # this many blocks; larger sources have larger blocks
BROADCAST = 100_000        # rows of the small tables that are broadcast; longer ones are joined by shuffle


def fill(sizes: list[int], weights: list[float], share: float = SHARE,
         most: float = MOST) -> list[float]:
    """Targets by weight that stop at ``most`` times their size, the excess
    reshared by weight until none is above."""
    total, targets = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        each = total / sum(weights[i] for i in free)
        full = [i for i in free if each * weights[i] >= most * sizes[i]]
        if not full:
            for i in free:
                targets[i] = each * weights[i]
            break
        for i in full:
            targets[i] = most * sizes[i]
            total -= targets[i]
        free = [i for i in free if i not in full]
    return targets


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard the blocks it gets of each source, by a splitting tree."""
    rng = np.random.default_rng(seed)

    def part(left: list[int], n: int) -> list[list[int]]:
        if n == 1:
            return [left]
        half = n // 2
        drawn = rng.multivariate_hypergeometric(left, sum(left) * half // n, method="marginals")
        a = [int(x) for x in drawn]
        return part(a, half) + part([x - y for x, y in zip(left, a)], n - half)
    return part(quotas, shards)


def _key(seed: str, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver rows, to be broadcast if it has few."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST else df


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
         most: float = MOST, shards: int = SHARDS, seed: str = SEED,
         block_words: int = BLOCK_WORDS, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    taken, drawn (words of it in the last pass) and shards (one for each time
    it is taken).

    Sources stand by code point, null last, and have the weights in turn. The
    last document of a quota is taken in part: ``taken`` counts its words as far
    as the quota goes, so the words taken of a source add up to its target,
    rounded. Null, empty and blank texts have no words and take no part of a quota. Rows that
    repeat an id are told apart by size; equal rows may swap. Ties of a hash go by id.
    Other columns are ignored; an empty table gives no rows. Runs jobs when
    called: narrow rows (no text) are written to the shared folder, and one row
    for each source comes to the driver.
    """
    spark = docs.sparkSession
    narrow = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size")))
    stats = [(r["source"], int(r["words"]), int(r["rows"])) for r in narrow.groupBy("source").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()]
    stats.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    targets = fill([w for _, w, _ in stats], [weights[i % len(weights)] for i in range(len(stats))],
                   share, most)
    s = _small(spark, [(s, w, t, min(blocks, 1 + (w + n) // block_words),
                        min(int(round(t)) // w, int(most)) if w else 0) for (s, w, n), t in zip(stats, targets)],
               "_s string, source_size long, target double, blocks int, whole int")
    rows = narrow.join(s, narrow["source"].eqNullSafe(F.col("_s"))).drop("_s").withColumns({
        "block": F.pmod(_key(seed, F.col("doc_id")), F.col("blocks").cast("long")).cast("int"),
        "rest": (F.round("target") - F.col("whole") * F.col("source_size")).cast("long")})
    of_block = Window.partitionBy("source", "block")
    before = F.sum("size").over(of_block.orderBy(
        _key(seed + "/doc", F.col("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0)))
    # at most `blocks` rows for each source
    words = rows.groupBy("source", "block", "whole", "rest").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy(
        _key(seed + "/quota", F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1))
    sized = checkpointed(words.withColumn("quota", F.greatest(F.lit(0), F.least(
        "words", F.col("rest") - F.coalesce(earlier, F.lit(0))))).drop("rest"))
    # block units: every whole pass and the part that the quota draws
    units = sized.select("source", "block", "quota", F.explode(F.concat(
        F.when(F.col("whole") > 0, F.sequence(F.lit(1), F.col("whole"))).otherwise(F.array()),
        F.when(F.col("quota") > 0, F.array(F.lit(0))).otherwise(F.array()))).alias("pass"))
    counted = {r["source"]: r["n"] for r in units.groupBy("source").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    order = [x for x, _, _ in stats]
    number = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big")
    tree = split_quotas([counted.get(x, 0) for x in order], shards, number) if order else []
    ends, up = [], {x: 0 for x in order}
    for shard, got in enumerate(tree):
        for x, n in zip(order, got):
            if n:
                ends.append((x, shard, up[x], up[x] + n))
                up[x] += n
    cuts = _small(spark, ends, "_s string, shard int, lo int, hi int")
    place = F.row_number().over(Window.partitionBy("source").orderBy(
        _key(seed + "/deal", F.col("block"), F.col("pass")), "block", "pass")) - 1
    dealt = units.withColumn("at", place).join(cuts, F.col("source").eqNullSafe(
        F.col("_s")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    by_block = dealt.groupBy("source", "block").agg(
        F.max("quota").alias("quota"),
        F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    b = by_block.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "quota", "dealt")
    joined = rows.join(b, rows["source"].eqNullSafe(b["_s"]) & (rows["block"] == b["_b"]), "left")
    drawn = F.greatest(F.lit(0), F.least("size", F.coalesce("quota", F.lit(0)) - F.col("before")))
    dealt_to = F.coalesce("dealt", F.array().cast("array<struct<pass:int,shard:int>>"))
    return joined.withColumn("drawn", drawn.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("drawn")).alias("taken"), "drawn",
        F.transform(F.filter(dealt_to, lambda x: (F.col("size") > 0)
                             & ((x["pass"] > 0) | (F.col("drawn") > 0))),
                    lambda x: x["shard"]).alias("shards"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word, white space between them as it is."""
    return F.array_join(F.slice(F.split(text, f"(?<={WORD[:-1]})(?={SPACE[:-1]})"), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = SEED, **kinds) -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``mix_shard``, one row for each
    time that a document is taken, shuffled inside its shard.

    It holds the words that ``plan`` counts as taken: documents come whole, but for the
    one at which a source's quota ends, whose text comes up to there. Parameters and cases
    as in ``plan``; rows that agree in id, source and number of words are all taken as often
    as the one of them that is taken most.
    """
    took = plan(docs, id_col, text_col, source_col, seed=seed, **kinds).where("size(shards) > 0")
    by_row = took.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                          F.col("size").alias("__size")).agg(
        F.max_by(F.struct("shards", "drawn"), F.struct("taken", "shards")).alias("__took"))
    rows = docs.drop("mix_shard").withColumn("__words", n_words(F.col(text_col)))
    rows = rows.join(by_row, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size"))
                     & F.col(source_col).eqNullSafe(F.col("__source")))
    columns = [c for c in docs.columns if c != "mix_shard"]
    each = rows.select(*columns, "__words", F.col("__took.drawn").alias("__drawn"),
                       F.posexplode("__took.shards").alias("__time", "mix_shard"))
    # the drawn part is the first of a document's shards
    part = (F.col("__time") == 0) & F.col("__drawn").between(1, F.col("__words") - 1)
    each = each.withColumn(text_col, F.when(part, first_words(F.col(text_col), F.col("__drawn"))).otherwise(
        F.col(text_col))).drop("__words", "__drawn")
    each = each.withColumn("__at", _key(seed + "/row", F.col(id_col), F.col("__time")))
    return each.repartition("mix_shard", F.pmod("__at", F.lit(64))).sortWithinPartitions(
        "mix_shard", "__at").drop("__time", "__at")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = plan(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source",
                      F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards"))
