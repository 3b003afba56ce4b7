"""MinHash near-dedup with sequential Bayesian verification.

Documents link when the Jaccard similarity of their sets of 4-word shingles is 0.8
or more.

1. Documents with equal sets (by a digest of 128 bits) are one class. Each set has
   ``BANDS`` band keys of ``ROWS`` minima each, and apart from these a signature of
   ``SIGNATURE`` minima of 16 bits, so that what made a candidate says nothing in its trial.
2. Classes with a band key in common share a bucket. Buckets with the same members
   (count and two checksums) are looked at once. Larger buckets are cut into parts, each
   with the bucket's smallest class as a pivot.
3. Sequential Bayesian verification inside the parts: signatures are compared a batch of
   ``BATCH`` minima at a time. With a uniform prior, m of n equal minima give the
   similarity the posterior Beta(m + 1, n - m + 1); a pair goes as soon as the posterior
   probability of 0.8 or more falls below ``MISS``. Pairs that survive connect
   families; a part emits a spanning forest of them, never all pairs.
4. Survivors are verified exactly: the texts of family members are read again, and
   their whole sets intersected, in parts of at most ``PART_TOKENS`` words and
   ``PART`` members that hold the family's smallest class too. Pairs that are connected
   need no look.
5. Across the parts of one bucket or family: members outside the group's largest
   component meet all its parts, pairs with the same component left out. In a group
   of near copies, which the pivot holds together, few are outside.
6. Components of all links.

Every link is exact. One is missed if no band key of a pair agrees (at a similarity of 0.8
once in 10^7 pairs, (1 - 0.8^4)^32; less often above) or its trial ends it (``MISS`` a batch).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, new_path, read_table, sieved
from .components import components
from .shingles import mix, shingle_sets

WORDS = 4
PERCENT = 80
BANDS, ROWS = 32, 4
SIGNATURE, BATCH = 128, 32
MISS = 1e-7                # least posterior probability of a link for a pair to stay
PART = 1_024               # members of a part
PART_TOKENS = 1 << 20      # words of the texts in a part; a longer text goes alone with the pivot
PORTION = 1 << 16          # shingles that are hashed at once
SLICE = 1_024              # rows of an Arrow batch whose sets are in memory at once

_N = BANDS * ROWS + SIGNATURE
_FACTORS = mix(np.arange(1, _N + 1, dtype=np.uint64)) | np.uint64(1)


# ------------------------------------------------------------- signatures

def class_of(tokens: np.ndarray) -> bytes:
    """128 bits of a digest of the set; no bytes for the empty one."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else b""


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, which must not be empty, the least value of every hash function."""
    out = np.empty((len(sets), _N), np.uint64)
    at = 0
    while at < len(sets):
        stop, size = at + 1, len(sets[at])
        while stop < len(sets) and size + len(sets[stop]) <= PORTION:
            size += len(sets[stop])
            stop += 1
        tokens = np.concatenate(sets[at:stop])
        starts = np.cumsum([0] + [len(s) for s in sets[at:stop - 1]])
        for k, factor in enumerate(_FACTORS):
            h = tokens * factor
            h ^= h >> np.uint64(32)
            out[at:stop, k] = np.minimum.reduceat(h, starts)
        at = stop
    return out


def _band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(least), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(least), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least[:, b * ROWS + r])
        keys[:, b] = h
    return keys.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, set, n, keys, sig) of every row of (doc_id, text); of rows of one slice
    with equal sets only one has keys and sig."""
    def run(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            own = [class_of(s) for s in sets]
            one = {c: i for i, c in enumerate(own) if c}
            rows = sorted(one.values())
            keys: list = [None] * len(sets)
            sig: list = [None] * len(sets)
            if rows:
                least = minima([sets[i] for i in rows])
                bands = _band_keys(least)
                short = (least[:, BANDS * ROWS:] >> np.uint64(16)).astype(np.uint16)
                for k, i in enumerate(rows):
                    keys[i], sig[i] = bands[k], short[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(own, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["doc_id", "set", "n", "keys", "sig"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, set binary, n long, keys array<long>, sig binary")


# ------------------------------------------------------------- the posterior

@lru_cache(maxsize=None)
def least_equal(n: int, percent: int, miss: float) -> int:
    """The least number of equal minima out of n with which a pair stays: the posterior
    probability of a similarity of ``percent`` / 100 or more is ``miss`` at least. For
    Beta(m + 1, n - m + 1) it is the probability of at most m hits in n + 1 draws."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(left: np.ndarray, right: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Which of the pairs of signatures (rows of both) stay after all batches. A
    minimum of 16 bits may agree by chance, which lets more pass, never fewer."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int32)
    for at in range(0, left.shape[1], BATCH):
        equal = equal + (left[alive, at:at + BATCH] == right[alive, at:at + BATCH]).sum(axis=1, dtype=np.int32)
        keep = equal >= least_equal(min(at + BATCH, left.shape[1]), percent, miss)
        alive, equal = alive[keep], equal[keep]
        if not len(alive):
            break
    return alive


class Groups:
    """Members 0..n-1 and the group of each."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]


def _pairs(groups: Groups, sig: np.ndarray, side: np.ndarray, label: np.ndarray, n: np.ndarray, percent: int,
           miss: float) -> Iterator[tuple[int, int]]:
    """Surviving pairs i < j of members that are not in one group yet when their turn
    comes. Left out are pairs of one side or one label (where these are told) and of
    sizes that cannot link."""
    for i in range(len(sig) - 1):
        js = np.arange(i + 1, len(sig))
        fit = groups.of[js] != groups.of[i]
        fit &= 100 * np.minimum(n[i], n[js]) >= percent * np.maximum(n[i], n[js])
        if side[i] >= 0:
            fit &= (side[js] != side[i]) & (label[js] != label[i])
        js = js[fit]
        if len(js):
            for j in js[survivors(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], percent, miss)].tolist():
                if groups.of[i] != groups.of[j]:
                    yield i, j


# ------------------------------------------------------------- parts of groups

def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal first ``keys`` columns of sorted batches."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield rows
                now, rows = row[:keys], []
            if not rows or rows[-1][keys] != row[keys]:        # a class once
                rows.append(row)
    if rows:
        yield rows


def dealt(members: DataFrame, size: str) -> DataFrame:
    """Rows (key, set, ...) of groups with ``part`` and ``parts``: parts hold at most about ``PART``
    members and ``PART_TOKENS`` of ``size``, and all parts of a group its smallest class."""
    sizes = members.groupBy("key").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum(size) / PART_TOKENS)).alias("parts"),
        F.min("set").alias("pivot"))
    rows = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("set"), "parts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    places = F.when((F.col("set") == F.col("pivot")) & (F.col("parts") > 1), every).otherwise(F.array("part"))
    return rows.withColumn("part", F.explode(places)).drop("pivot")


def across(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Of groups in parts: members outside the group's largest component (``found``: node,
    component) beside every part, as (key, part, set, side, label, ...)."""
    rows = rows.where("parts > 1").join(found, F.col("set") == F.col("node"), "left").withColumn(
        "label", F.xxhash64(F.coalesce("component", "set"))).drop("node", "component")
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n_label"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n_label", "label")).alias("most"))
    rows = rows.join(most, "key").withColumn("odd", F.col("label") != F.col("most.label")).drop("most")
    odd = rows.where("odd")
    odd_parts = odd.select("key", F.col("part").alias("odd_part")).distinct()
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = odd.withColumn("to", every).where("to <> part").withColumn("part", F.col("part") * F.col("parts") + F.col("to")) \
        .withColumn("side", F.lit(0)).drop("to", "odd")
    right = rows.join(odd_parts, "key").where("odd_part <> part").withColumn("part", F.col("odd_part") * F.col("parts") + F.col("part")) \
        .withColumn("side", F.lit(1)).drop("odd_part", "odd")
    return left.unionByName(right)


def _told(rows: DataFrame) -> DataFrame:
    have = rows.columns
    for c, kind in (("side", "int"), ("label", "long")):
        if c not in have:
            rows = rows.withColumn(c, F.lit(-1).cast(kind))
    return rows


def _arrays(rows: list[tuple]):
    """set, n, sig, side, label of rows (key, part, set, side, label, n, sig, ...)."""
    sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(len(rows), -1)
    return ([r[2] for r in rows], np.array([r[5] for r in rows], np.int64), sig, np.array([r[3] for r in rows]),
            np.array([r[4] for r in rows], np.int64))


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def surviving(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b): in each part a spanning forest of the pairs whose trial they survive."""
    def run(batches):
        for members in _runs(batches, 2):
            sets, n, sig, side, label = _arrays(members)
            groups, a, b = Groups(len(sets)), [], []
            for i, j in _pairs(groups, sig, side, label, n, percent, miss):
                groups.join(i, j)
                a.append(sets[i])
                b.append(sets[j])
            if a:
                yield _edges(a, b)
    rows = _told(rows).select("key", "part", "set", "side", "label", "n", "sig")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "set").mapInArrow(
        run, "a binary, b binary")


def verified(rows: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """(a, b): in each part a spanning forest of the links, by the whole sets. Rows have ``text``."""
    def run(batches):
        for members in _runs(batches, 2):
            sets, n, sig, side, label = _arrays(members)
            tokens: dict[int, np.ndarray] = {}
            groups, a, b = Groups(len(sets)), [], []

            def shingles(i: int) -> np.ndarray:
                if i not in tokens:
                    tokens[i] = shingle_sets([members[i][7]], words)[0]
                return tokens[i]

            for i, j in _pairs(groups, sig, side, label, n, percent, miss):
                both = len(np.intersect1d(shingles(i), shingles(j), assume_unique=True))
                if 100 * both >= percent * (int(n[i]) + int(n[j]) - both):
                    groups.join(i, j)
                    a.append(sets[i])
                    b.append(sets[j])
            if a:
                yield _edges(a, b)
    rows = _told(rows).select("key", "part", "set", "side", "label", "n", "sig", "text")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "set").mapInArrow(
        run, "a binary, b binary")


def _texts(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(set, text) of the classes in ``members`` (set, doc_id). Rows that repeat an id, a null
    one too, may have different texts: the class of its own text tells whether a row is meant."""
    def run(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            own = [class_of(s) for s in shingle_sets(batch.column("text").to_pylist(), words)]
            one = sorted({c: i for i, c in enumerate(own)}.values())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column("text")],
                                             names=["own", "text"]).take(pa.array(one, pa.int64()))
    some = sieved(docs, "doc_id", members, "doc_id").where("__maybe").select("text").mapInArrow(
        run, "own binary, text string")
    return members.select("set").join(some, F.col("set") == F.col("own")).groupBy("set").agg(
        F.min("text").alias("text"))


# ------------------------------------------------------------- the operator

def buckets(classes: DataFrame) -> DataFrame:
    """(key, set): buckets of two classes or more, one of those with the same members."""
    rows = classes.select(F.explode("keys").alias("key"), "set")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    path = new_path(classes.sparkSession, "buckets")
    rows.join(shared.select("key"), "key").write.parquet(path)
    rows = classes.sparkSession.read.parquet(path)
    one = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("times"), F.bit_xor(F.xxhash64("set")).alias("x"),
        F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y")).groupBy("times", "x", "y").agg(F.min("key").alias("key"))
    return rows.join(one.select("key"), "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that links lead to, the row's own included; ``kept``
    says that it is the row's own. Words are told apart after lower-casing A-Z. A text of
    fewer words than a shingle is one shingle; null, empty or blank texts have none and
    link with nothing. Rows that repeat an id are judged by their own texts, and those
    with the component's smallest id are all kept; a null id is never the smallest unless
    all of a component are null. Other columns are ignored; an empty table gives no rows.
    Runs jobs when called; intermediate tables are written to the shared folder.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    path = new_path(docs.sparkSession, "signatures")
    signatures(docs, words).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    some = rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    with_keys = rows.where("sig IS NOT NULL").select(F.col("set").alias("s"), "keys", "sig").groupBy("s").agg(
        F.min("keys").alias("keys"), F.min("sig").alias("sig"))
    path = new_path(docs.sparkSession, "classes")
    some.join(with_keys, F.col("set") == F.col("s")).drop("s").write.parquet(path)
    classes = docs.sparkSession.read.parquet(path)
    slim = classes.select("set", "doc_id", "n", "sig")

    candidates = checkpointed(dealt(buckets(classes).withColumn("one", F.lit(0)), "one").drop("one").join(
        slim.drop("doc_id"), "set"))
    pairs = checkpointed(surviving(candidates, percent, miss))
    families = components(pairs)
    if not candidates.where("parts > 1").isEmpty():
        pairs = checkpointed(pairs.unionByName(surviving(across(candidates, families), percent, miss)))
        families = components(pairs)

    members = checkpointed(families.select(F.col("component").alias("key"), F.col("node").alias("set")).join(slim, "set"))
    path = new_path(docs.sparkSession, "family-texts")
    dealt(members.drop("doc_id"), "n").join(_texts(docs, members, words), "set").write.parquet(path)
    placed = docs.sparkSession.read.parquet(path)
    links = checkpointed(verified(placed, words, percent, miss))
    if not placed.where("parts > 1").isEmpty():
        links = checkpointed(links.unionByName(verified(across(placed, components(links)), words, percent, miss)))

    named = slim.select("set", "doc_id").join(components(links), F.col("set") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "set"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(least, "component").select("set", "component_id")
    out = rows.select("doc_id", "set", F.col("n").alias("n_shingles")).join(by_set, "set", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (sh)
      WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM r GROUP BY a) m USING (doc_id)
"""
