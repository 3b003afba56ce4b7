"""N-gram Jaccard join with signature trees.

Documents link when the Jaccard similarity of their sets of 5-word shingles is
0.8 or more; the join is exact.

1. One pass makes each document's set, its digest and bitmap. Documents with equal
   sets are one class. A second pass counts in how many classes each token is.
2. Blocks: two sets that link share a token among the first |A| - ceil(0.8 |A|)
   + 1 tokens of each, in any common order of all tokens. The order is by hash, with
   the ``FREQUENT`` most widespread tokens behind all others, the rarer first, so that
   no passage of many documents makes a block that grows with the table. (Which tokens
   these are is a matter of speed alone; the list's length bounds what is broadcast.) A
   class belongs to the block of the smallest class that it shares a token with.
3. In each block the classes' bitmaps form signature trees (``signature_tree``)
   whose dual traversal leaves candidate pairs. Their connected groups are
   families; equal families of several blocks are one.
4. The texts of family members alone are read again and pairs verified, by dual
   traversal once more. Pairs that are connected already need no check, so a family
   of near copies emits a spanning forest of its links.
5. Blocks of more than ``PART_MEMBERS`` classes or ``PART_TOKENS`` tokens are cut
   into parts by hash. After the parts, links are sought between the members
   outside the block's largest component and all parts; what is connected
   already needs none, so a huge group of near copies stays linear.
6. Components of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, new_path, read_table, sieved, small_batches
from .components import components
from .shingles import shingle_sets
from .signature_tree import between, bitmap, candidates, joined, trees

WORDS = 5
PERCENT = 80
FREQUENT = 200_000        # tokens that the order puts last (12 bytes each, broadcast)
OFTEN = 16                # sets that make a token a candidate for that
SPAN_TOKENS = 1 << 18     # tokens that are counted at once, more where ``SPAN_BITS`` are too few
SPAN_BITS = 12
PART_TOKENS = 1 << 22     # tokens of the sets in one part of a block, 2 MB of bitmaps
PART_MEMBERS = 2_048


def _long(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _class_of(tokens: np.ndarray) -> int:
    """64 bits of a digest of the set; 0 is kept for the empty set."""
    return _long(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest()) or 1 if len(tokens) else 0


def _prefix(n: int, percent: int) -> int:
    return n + (percent * n) // -100 + 1  # n - ceil(percent n / 100) + 1


def _texts(batches: Iterator[pa.RecordBatch], words: int):
    for batch in batches:
        yield batch, shingle_sets(batch.column("text").to_pylist(), words)
    pa.default_memory_pool().release_unused()  # idle workers keep what they hold


def _signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, set, n, bits) of every row, set 0 being the empty one. Of equal sets in
    a batch the first has the bitmap."""
    def run(batches):
        for batch, sets in _texts(batches, words):
            own = [_class_of(s) for s in sets]
            first = {k: i for i, k in reversed(list(enumerate(own)))}
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(own, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bitmap(s) if len(s) and first[k] == i else None
                          for i, (k, s) in enumerate(zip(own, sets))], pa.binary())],
                names=["doc_id", "set", "n", "bits"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, set long, n long, bits binary")


def _counted(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(key, times): in how many sets the tokens are that ``OFTEN`` sets or more have, all
    tokens counted. A key is the first 32 + ``bits`` bits of a token. Tokens are
    gathered by their first ``bits`` bits, four bytes each, and counted by sorting them."""
    def cut(batches):
        ends = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)
        for _, sets in _texts(batches, words):
            own = {_class_of(s): s for s in sets if len(s)}
            if own:
                keys = np.concatenate(list(own.values()))
                keys >>= np.uint64(32 - bits)
                keys.sort()
                at = np.searchsorted(keys, ends)
                full = pa.array(np.flatnonzero(np.diff(at)))
                tokens = pa.Array.from_buffers(pa.binary(), 1 << bits, [
                    None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(keys.astype(np.uint32))])
                yield pa.RecordBatch.from_arrays([full, tokens.take(full)], names=["span", "tokens"])

    def count(batches):
        for (span,), rows in _runs(batches, 1):
            keys, times = np.unique(np.frombuffer(b"".join(t for t, in rows), np.uint32), return_counts=True)
            many = times >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array((span << 32) + keys[many].astype(np.int64)),
                                              pa.array(times[many].astype(np.int64))], names=["key", "times"])
        pa.default_memory_pool().release_unused()
    return docs.select("text").mapInArrow(cut, "span long, tokens binary").repartition("span").sortWithinPartitions(
        "span").mapInArrow(count, "key long, times long")


def _widespread(docs: DataFrame, classes: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``FREQUENT`` tokens that most sets of ``docs`` have, as sorted keys, their
    ranks, the rarest first, and how many bits of a token follow its key."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = min(SPAN_BITS, (total // SPAN_TOKENS).bit_length())
    counted = checkpointed(_counted(docs, words, bits))
    least, room = 0, FREQUENT
    for times, n in sorted(map(tuple, counted.groupBy("times").count().collect()), reverse=True):
        if room <= 0:
            break
        least, room = times, room - n
    found = counted.where(F.col("times") >= least).orderBy(F.desc("times"), "key").limit(FREQUENT).toArrow()
    keys = np.asarray(found["key"].combine_chunks()).view(np.uint64)
    times = np.asarray(found["times"].combine_chunks())
    order, rank = np.argsort(keys), np.empty(len(keys), np.int32)
    rank[np.lexsort((keys, times))] = np.arange(len(keys), dtype=np.int32)
    return keys[order], rank[order], 32 - bits


def _tokens(docs: DataFrame, words: int, percent: int, last: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """(set, n, tokens, behind): the prefix of every set in order; the tokens of ``last``
    (``_widespread``) come behind all others by their ranks and are so many of them."""
    last = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        behind, rank, more = last.value
        for _, sets in _texts(batches, words):
            lead, own, sizes, wide = [], [], [], []
            for which, s in {_class_of(s): s for s in sets if len(s)}.items():
                need, few, first = _prefix(len(s), percent), 0, s
                if len(behind):
                    keys = s >> np.uint64(more)
                    at = np.minimum(np.searchsorted(behind, keys), len(behind) - 1)
                    late = behind[at] == keys
                    if late.any():
                        first = s[~late]
                        few = max(0, need - len(first))
                        first = np.concatenate([first, s[late][np.argsort(rank[at[late]], kind="stable")[:few]]])
                lead.append(first[:need])
                wide.append(few)
                own.append(which)
                sizes.append(len(s))
            if lead:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in lead])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lead).view(np.int64))),
                    pa.array(wide, pa.int32())], names=["set", "n", "tokens", "behind"])
    return docs.select("text").mapInArrow(run, "set long, n long, tokens array<long>, behind int")


def _blocks(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(block, set): all pairs of sets that may link are in a block together. Prefixes
    come from the rows that stand for a class (and few others, which add nothing)."""
    spark = docs.sparkSession
    path = new_path(spark, "prefix-tokens")
    some = sieved(docs, "doc_id", classes, "doc_id").where("__maybe")
    _tokens(some, words, percent, _widespread(some, classes, words)).write.parquet(path)
    prefixes = spark.read.parquet(path)
    size, behind = F.size("tokens"), F.col("behind")

    def rows(tokens, first):
        """(token, set, sizes); sizes is n and how many tokens of the set there are from this
        one on, in one number."""
        return prefixes.select("set", "n", first.alias("first"),
                               F.posexplode(tokens).alias("at", "token")).select(
            "token", "set", (F.shiftleft("n", 32) + F.col("n") - F.col("first") - F.col("at")).alias("sizes"))

    n, rest = F.shiftright("sizes", 32), F.col("sizes").bitwiseAND((1 << 32) - 1)
    found = {"block": F.min("set"), "other": F.max("set")}
    several = F.col("block") < F.col("other")
    # One shuffle for most tokens, whose groups are small; the widespread ones, few
    # enough to broadcast, are added up in the tasks and never gathered.
    own = Window.partitionBy("token")
    most = rows(F.slice("tokens", F.lit(1), size - behind), F.lit(0)).withColumns(
        {k: c.over(own) for k, c in found.items()}).where(several).select(
        "token", "set", n.alias("n"), rest.alias("rest"))
    # Sets that link differ in size by ``percent`` at most, so a token's rows in order of
    # size fall into chains wherever the next is larger than that, a block each.
    by_size = own.orderBy("n", "set")
    apart = F.lag("n").over(by_size) * 100 < F.col("n") * percent
    chained = most.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn(
        "chain", F.sum("apart").over(by_size))
    of_chain = Window.partitionBy("token", "chain")
    chained = chained.withColumns({k: c.over(of_chain) for k, c in {
        **found, "times": F.count(F.lit(1)), "small": F.min("n"), "large": F.max("n"), "least": F.min("rest")}.items()})
    # What follows in a set must suffice for the overlap with the smallest set there; where only
    # two rows are left, in both. (Of a linked pair the first common token passes.)
    enough = F.col("rest") * (100 + percent) >= (F.col("n") + F.col("small")) * percent
    both = F.col("least") * (100 + percent) >= (F.col("small") + F.col("large")) * percent
    most = chained.where(several & enough & ((F.col("times") > 2) | both))
    wide = rows(F.slice("tokens", size - behind + 1, behind), size - behind)
    blocks = wide.groupBy("token").agg(*[c.alias(k) for k, c in found.items()]).where(several).select("token", "block")
    return most.select("block", "set").unionByName(
        wide.join(F.broadcast(blocks), "token").select("block", "set")).distinct()


def _bitmaps(signatures: DataFrame, members: DataFrame) -> DataFrame:
    """(set, n, bits) of the sets of ``members`` and few others, one row each."""
    rows = signatures.where("bits IS NOT NULL").select("set", "n", "bits")
    return sieved(rows, "set", members, "set").where("__maybe").groupBy("set").agg(
        F.min("n").alias("n"), F.min("bits").alias("bits"))


def _runs(batches: Iterator[pa.RecordBatch], keys: int):
    """(key, rows) of batches that are sorted by their first ``keys`` columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _families(members: DataFrame, percent: int) -> DataFrame:
    """(family, set) of rows (block, part, side, label, set, n, bits): the groups that
    candidate pairs connect. Pairs with the same side or the same label don't
    count, unless these are null."""
    def run(batches):
        for _, rows in _runs(batches, 2):
            rows.sort(key=lambda r: (r[0] or 0, len(r[4]), r[4], r[2]))
            union, pairs = _Union(len(rows)), False
            items, left = [(r[3], r[4]) for r in rows], sum(r[0] == 0 for r in rows)
            if rows[0][0] is None:
                found = candidates(trees(items), percent, joined(union.root))
            else:
                found = between(trees(items[:left]), trees(items[left:], left), percent, joined(union.root))
            for i, j in found:
                a, b = rows[i], rows[j]
                if a[2] != b[2] and (a[0] is None or a[1] != b[1]):
                    pairs = union.join(i, j) or pairs
            if not pairs:
                continue
            groups: dict[int, set[int]] = {}
            for i, r in enumerate(rows):
                groups.setdefault(union.root(i), set()).add(r[2])
            key, own = [], []
            for g in groups.values():
                if len(g) > 1:
                    ids = np.array(sorted(g), np.int64)
                    key += [_long(hashlib.blake2b(ids.tobytes(), digest_size=8).digest())] * len(ids)
                    own.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.concatenate(own))],
                                             names=["family", "set"])
    rows = members.select("block", "part", "side", "label", "set", "n", "bits")
    return rows.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(
        run, "family long, set long").distinct()


def _classed(rows: DataFrame, words: int) -> DataFrame:
    """(__id, __set, text) of rows (doc_id, text). Of rows of one Arrow batch that
    repeat both, one is left."""
    def run(batches):
        for batch, sets in _texts(batches, words):
            own = [_class_of(s) for s in sets]
            one = {k: i for i, k in enumerate(zip(batch.column("doc_id").to_pylist(), own))}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(own, pa.int64()), batch.column("text")],
                names=["__id", "__set", "text"]).take(pa.array(list(one.values()), pa.int64()))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text").mapInArrow(run, f"__id {kind}, __set long, text string")


def _firsts(batches: Iterator[pa.RecordBatch]):
    """Sorted batches without the rows that repeat the first two columns."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        keep = [a != b for a, b in zip(keys, [last, *keys])]
        last = keys[-1] if keys else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def _verified(families: DataFrame, classes: DataFrame, docs: DataFrame, words: int,
              percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links inside every family."""
    def run(batches):
        for _, rows in _runs(_firsts(batches), 1):
            sets = shingle_sets([t for _, t in rows], words)
            order = sorted(range(len(rows)), key=lambda i: sets[i].tobytes()[:64])
            items = [(len(sets[i]), bitmap(sets[i])) for i in order]
            union, a, b = _Union(len(rows)), [], []
            for x, y in candidates(trees(items), percent, joined(union.root)):
                i, j = order[x], order[y]
                if union.root(x) == union.root(y):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    union.join(x, y)
                    a.append(rows[i][0])
                    b.append(rows[j][0])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                 names=["a", "b"])
    spark = docs.sparkSession
    path = new_path(spark, "families")
    families.join(classes.select("set", "doc_id"), "set").write.parquet(path)
    members = spark.read.parquet(path)
    # rows that repeat an id, a null one too, may have different texts: the class tells which is meant
    some = _classed(sieved(docs, "doc_id", members, "doc_id").where("__maybe"), words)
    texts = some.join(members.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("doc_id"))
                      & (F.col("__set") == F.col("set"))).select("family", "set", "text")
    return texts.repartition("family").sortWithinPartitions("family", "set").mapInArrow(
        run, "a long, b long")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest id that links lead to, the row's own included.
    Words are told apart after lower-casing A-Z. A text of fewer words than a shingle is
    one shingle; null, empty or blank texts have none and link with nothing. Rows
    that repeat an id are judged by their own texts; a null id is never the
    smallest unless all of a component are null. Other columns are ignored; an
    empty table gives no rows. Similarities from 50 percent are supported. Runs
    jobs when called; intermediate tables are written to the shared folder. Lowers the
    session's Arrow batches (``small_batches``).
    """
    return _linked(docs, id_col, text_col, words, percent).drop("set")


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """doc_id, set, n_shingles, component_id of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signatures = checkpointed(_signatures(docs, words, percent))
    classes = checkpointed(signatures.where("n > 0").groupBy("set").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n")))
    blocks = checkpointed(_blocks(docs, classes, words, percent))
    sized = blocks.join(classes.select("set", "n"), "set").groupBy("block").agg(
        F.greatest(F.ceil(F.sum("n") / PART_TOKENS), F.ceil(F.count(F.lit(1)) / PART_MEMBERS)).alias("parts"),
        F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    placed = checkpointed(blocks.join(sized, "block").withColumn("part", F.pmod(F.xxhash64("set"), "parts")))
    nothing = F.lit(None).cast("long")
    inside = _families(_bitmaps(signatures, placed).join(placed, "set").withColumns({"side": nothing, "label": nothing}), percent)
    links = checkpointed(_verified(inside, classes, docs, words, percent))
    large = placed.where("parts > 1")
    if not large.isEmpty():
        links = checkpointed(links.unionByName(_verified(
            _families(_across(large, _bitmaps(signatures, large), components(links)), percent), classes, docs, words, percent)))
    found = components(links)
    named = classes.select("set", "doc_id").join(found, F.col("set") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "set"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(least, "component").select("set", "component_id")
    out = signatures.select("doc_id", "set", "n").join(by_set, "set", "left")
    return out.select("doc_id", "set", F.col("n").alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def _across(large: DataFrame, bitmaps: DataFrame, found: DataFrame) -> DataFrame:
    """Members of blocks in parts, dealt so that each member outside its block's
    largest component meets every part of the block."""
    rows = large.join(found, F.col("set") == F.col("node"), "left").select(
        "block", "set", "parts", "part", F.coalesce("component", "set").alias("label"))
    sizes = rows.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("block").agg(F.max(F.struct("n", "label")).alias("most"))
    rows = checkpointed(rows.join(most, "block").withColumn("odd", F.col("label") != F.col("most.label")))
    odd = rows.where("odd")
    odd_parts = odd.select("block", F.col("part").alias("odd_part")).distinct()
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = odd.withColumn("to", every).select(
        "block", (F.col("part") * F.col("parts") + F.col("to")).alias("part"), F.lit(0).cast("long").alias("side"),
        "label", "set")
    right = rows.join(odd_parts, "block").select(
        "block", (F.col("odd_part") * F.col("parts") + F.col("part")).alias("part"),
        F.lit(1).cast("long").alias("side"), "label", "set")
    return bitmaps.join(left.unionByName(right), "set")


def _set_of(words: int):
    """The class of each text, as a function of columns."""
    def run(text: pa.Array) -> pa.Array:
        return pa.array([_class_of(s) for s in shingle_sets(text.to_pylist(), words)], pa.int64())
    return F.arrow_udf(run, "long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest
    id. Rows of the component that repeat this id all stay, and so do texts without
    words. Rows that repeat an id, a null one too, stay or go by their own texts.
    """
    named = _linked(docs, id_col, text_col, words, percent)
    gone = named.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__gone"), F.col("set").alias("__set")).distinct()
    path = new_path(docs.sparkSession, "near-copies")
    gone.write.parquet(path)
    gone = docs.sparkSession.read.parquet(path)
    rows = sieved(docs, id_col, gone, "__gone")
    doubtful = rows.where("__maybe").withColumn("__own", _set_of(words)(F.col(text_col).cast("string"))).join(
        gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__gone")) & (F.col("__own") == F.col("__set")),
        "left_anti").drop("__own")
    return rows.where("NOT __maybe").unionByName(doubtful).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read_table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (sh)
      WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM r GROUP BY a) m USING (doc_id)
"""
