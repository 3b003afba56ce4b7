"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. An
automaton of four states (start, after system, after user, after assistant)
accepts that. Per row the edits are Keep (0), Rerole to the role the state asks for
(3) and Delete (4; the only one for blank rows and duplicates); rows with an
empty text may be Inserted anywhere (3); a truncated row that stays adds 3. The
cheapest edits are wanted, of equally cheap ones those whose initials are least.

1. Rows are dealt by range of (conversation, turn), so a long conversation lies in
   many partitions, and cut into chunks of at most ``CHUNK`` rows. A row is one
   hex digit to the Viterbi: role initial, must go, truncated.
2. Backward cost vectors (least cost to the end from each state) of all chunks start
   at once from a speculative vector, as if the conversation ended there.
3. Fix-up passes: where the vector a chunk started from is not its right
   neighbour's, the chunk reruns from that one until the vectors of both runs differ by a
   constant only; from there on the old run holds but for the constant. Vectors are
   kept less their minimum, so that "differs by a constant" is equality. The spans
   in which chunks hand on their vectors grow ``FAN``-fold with every pass:
   rows that never let vectors converge (a conversation without a known role) take
   a pass per power of ``FAN``, not one per chunk.
4. The constants, summed, are the cost. With the stitched vectors each chunk is
   traced from all four states; the pieces are put together while the rows of a
   conversation stream by in order, which the digest of the repaired text needs anyway.
   No group is held in memory but the audit, a character an edit.

Nulls: a null role or text is one space, a null turn comes first and counts in no
gap, a null conversation id is a conversation of its own. Rows of one turn go by role,
then by digest of the text; repeated rows are duplicates. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, new_path, read_table

CHUNK = 128              # rows of a chunk
FAN = 16                 # growth of the span of a fix-up pass

# Costs of the edits, as the contract states.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SOLID = r"[^\x20\x09-\x0D]"

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)             # the state that an inserted or reroled row leads to
KEPT = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (ASSISTANT, 2): USER, (USER, 3): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(1, 2), (2, 3), (3, 2)}
FORCED, TRUNCATED = 4, 8                         # added to the role: 0 other, 1 system, 2 user, 3 assistant
END = (0, 2 * INSERT, INSERT, 0)                 # least cost from each state when no row follows

Vector = tuple[int, int, int, int]


# ------------------------------------------------------------- one row, one chunk

@lru_cache(maxsize=None)
def step(after: Vector, code: int) -> tuple[Vector, int, tuple[str, ...]]:
    """From the vector behind a row to the one before it: the vector less its
    minimum, the minimum, and the least initial of a cheapest edit for each state.
    There are few different vectors, so few steps are ever computed."""
    role, cut = code & 3, CUT if code & TRUNCATED else 0
    options = []
    for q in range(4):
        own = {"D": DELETE + after[q]}
        if not code & FORCED:
            if (q, role) in KEPT:
                own["K"] = cut + after[KEPT[q, role]]
            own["R"] = REROLE + cut + after[NEXT[q]]
        options.append(own)
    least = [min(own.values()) for own in options]
    before = [0] * 4
    before[USER] = min(least[USER], INSERT + least[ASSISTANT])
    before[ASSISTANT] = min(least[ASSISTANT], INSERT + least[USER])
    for q in (START, SYSTEM):
        before[q] = min(least[q], INSERT + before[USER])
    edits = []
    for q, own in enumerate(options):
        own["I"] = INSERT + before[NEXT[q]]
        edits.append(min(e for e, cost in own.items() if cost == before[q]))
    low = min(before)
    return tuple(b - low for b in before), low, tuple(edits)


def _codes(text: str) -> list[int]:
    return [int(c, 16) for c in text]


def backward(codes: list[int], after: Vector) -> tuple[Vector, int]:
    """The vector before a chunk from the one behind it, and the constant."""
    total = 0
    for code in reversed(codes):
        after, constant, _ = step(after, code)
        total += constant
    return after, total


def fixed_up(codes: list[int], old: Vector, new: Vector) -> tuple[Vector | None, int]:
    """A run from ``new`` beside the one from ``old``: (vector before the chunk,
    change of the constant). No vector if the runs came to differ by a constant."""
    change = 0
    for code in reversed(codes):
        if old == new:
            return None, change
        old, a, _ = step(old, code)
        new, b, _ = step(new, code)
        change += b - a
    return (None if old == new else new), change


def traced(codes: list[int], after: Vector, last: bool) -> tuple[list[int], list[str]]:
    """For each state before the chunk the state behind it and the initials of the
    cheapest edits, the least of them."""
    edits = []
    for code in reversed(codes):
        after, _, e = step(after, code)
        edits.append(e)
    states, audits = [], []
    for q in range(4):
        audit = []
        for code, e in zip(codes, reversed(edits)):
            while e[q] == "I":
                audit.append("I")
                q = NEXT[q]
            audit.append(e[q])
            q = KEPT[q, code & 3] if e[q] == "K" else NEXT[q] if e[q] == "R" else q
        while last and q in (SYSTEM, USER):
            audit.append("I")
            q = NEXT[q]
        states.append(q)
        audits.append("".join(audit))
    return states, audits


# ------------------------------------------------------------- rows and chunks

def _placed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Number the chunks of a sorted partition (``chunk``) and their rows (``at``)."""
    before, chunk, at, first = None, -1, 0, True
    for batch in batches:
        chunks, ats = [], []
        for conv in batch.column("conv_id").to_pylist():
            at += 1
            if first or conv != before or at == size:
                chunk, at, before, first = chunk + 1, 0, conv, False
            chunks.append(chunk)
            ats.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int64()), pa.array(ats, pa.int32())],
                                         names=[*batch.schema.names, "chunk", "at"])


def placed(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows (conv_id, turn, role, text[, copy]) with their place: part, chunk, at.
    Written to the shared folder, as everything that follows goes by these places."""
    spark = rows.sparkSession
    rows = rows.select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"),
                       F.monotonically_increasing_id().alias("uid"), "copy")
    order = ["conv_id", "turn", "role", "digest", "uid", "copy"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = dealt.select("conv_id", "turn", "role", "text", "digest", "part")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    path = new_path(spark, "conversation-rows")
    dealt.mapInArrow(lambda b: _placed(b, size), f"{kinds}, chunk long, at int").write.parquet(path)
    return spark.read.parquet(path)


def faults(rows: DataFrame) -> DataFrame:
    """The placed rows, less their texts, with the first fault of each: blank,
    duplicate, truncated (one of them true, or none), and ``code``."""
    text = F.col("text")
    solid = F.regexp_extract(text, rf"({SOLID})[\x20\x09-\x0D]*+\z", 1)
    slim = rows.select("conv_id", "turn", "role", "digest", "part", "chunk", "at", (solid == "").alias("blank"),
                       (~solid.isin(".", "!", "?")).alias("cut"))
    place = F.struct("part", "chunk", "at")
    firsts = slim.where("NOT blank").groupBy("conv_id", "role", "digest").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    joined = slim.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                       & (F.col("digest") == F.col("d")), "left")
    duplicate = ~F.col("blank") & F.coalesce(place > F.col("first"), F.lit(False))
    truncated = F.col("cut") & ~F.col("blank") & ~F.col("duplicate")
    initial = F.substring("role", 1, 1)
    code = (F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
            + F.when(F.col("blank") | F.col("duplicate"), FORCED).when(F.col("truncated"), TRUNCATED).otherwise(0))
    return joined.withColumn("duplicate", duplicate).withColumn("truncated", truncated).select(
        "conv_id", "turn", "part", "chunk", "at", "blank", "duplicate", "truncated", F.hex(code).alias("code"))


def _numbered(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``gid``: the number of a chunk among all, from its part and number there. The
    table of parts that goes into it has a row a Spark partition."""
    sizes = chunks.groupBy("part").agg((F.max("chunk") + 1).alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["n"]
    table = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return rows.join(F.broadcast(table), "part").withColumn("gid", F.col("start") + F.col("chunk")).drop(
        "start", "part", "chunk")


def chunked(flagged: DataFrame) -> DataFrame:
    """(gid, conv_id, codes, last, following): one row a chunk; ``following`` is the code
    behind the chunk in the same conversation."""
    chunks = flagged.groupBy("part", "chunk").agg(
        F.first("conv_id").alias("conv_id"),      # at most CHUNK rows are gathered
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
        .alias("codes"))
    chunks = checkpointed(chunks)
    chunks = _numbered(chunks, chunks)
    right = chunks.select((F.col("gid") - 1).alias("gid"), F.col("conv_id").alias("other"),
                          F.substring("codes", 1, 1).alias("following"))
    same = F.col("following").isNotNull() & F.col("conv_id").eqNullSafe(F.col("other"))
    return chunks.join(right, "gid", "left").select(
        "gid", "conv_id", "codes", (~same).alias("last"), F.when(same, F.col("following")).alias("following"))


# ------------------------------------------------------------- rank convergence

def _speculated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [backward(_codes(c), END) for c in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([END] * len(runs), pa.list_(pa.int32())),
             pa.array([v for v, _ in runs], pa.list_(pa.int32())), pa.array([c for _, c in runs], pa.int64())],
            names=[*batch.schema.names, "after", "lead", "constant"])


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from the right to the left; each starts from its right neighbour's
    vector, the one of this pass if the neighbour is in the same partition."""
    gid_before, lead_before = None, None
    for batch in batches:
        afters, leads, constants = [], [], []
        for gid, codes, last, old, lead, constant, right in zip(*(
                batch.column(c).to_pylist() for c in ("gid", "codes", "last", "after", "lead", "constant", "right"))):
            after = tuple(old)
            if not last:
                after = lead_before if gid_before == gid + 1 else tuple(right)
                new, change = fixed_up(_codes(codes), tuple(old), after)
                lead, constant = new or lead, constant + change
            gid_before, lead_before = gid, tuple(lead)
            afters.append(after)
            leads.append(lead)
            constants.append(constant)
        keep = [batch.column(c) for c in ("gid", "conv_id", "codes", "last", "following")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(afters, pa.list_(pa.int32())), pa.array(leads, pa.list_(pa.int32())),
             pa.array(constants, pa.int64())],
            names=["gid", "conv_id", "codes", "last", "following", "after", "lead", "constant"])


def converged(chunks: DataFrame) -> DataFrame:
    """The chunks with ``after`` and ``lead`` (vectors behind and before them, less their
    minimum) and ``constant`` (what the minimum rises by from the one to the other)."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    kinds += ", after array<int>, lead array<int>, constant long"
    state = checkpointed(chunks.mapInArrow(_speculated, kinds))
    span = 1
    while True:
        right = state.select((F.col("gid") - 1).alias("gid"), F.col("lead").alias("right"))
        beside = state.join(right, "gid", "left")
        if beside.where("NOT last AND right <> after").isEmpty():
            return state
        span *= FAN
        of = F.floor(F.col("gid") / span)
        state = checkpointed(beside.repartition(of).sortWithinPartitions(F.desc("gid")).mapInArrow(_fix_up, kinds))


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states, audits, illegal = [], [], []
        for codes, last, after, following in zip(*(
                batch.column(c).to_pylist() for c in ("codes", "last", "after", "following"))):
            own = _codes(codes)
            s, a = traced(own, tuple(after), last)
            states.append(s)
            audits.append(a)
            roles = [c & 3 for c in own + _codes(following or "")]
            illegal.append(sum(pair not in LEGAL for pair in zip(roles, roles[1:])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("gid"), batch.column("conv_id"), pa.array(illegal, pa.int64()), batch.column("constant"),
             pa.array([x[START] for x in batch.column("lead").to_pylist()], pa.int64()),
             pa.array(states, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))],
            names=["gid", "conv_id", "illegal", "constant", "at_start", "states", "audits"])


# ------------------------------------------------------------- the repaired text

def _conversations(batches: Iterator[pa.RecordBatch]):
    """(conv_id, edits) of batches sorted by (conv_id, gid, at), where a chunk's trace
    comes before its rows. ``edits`` yields (initial, role, text) and must be used up."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text", "states", "audits")))

    stream = rows()
    ahead = next(stream, None)

    def edits(conv):
        nonlocal ahead
        q, left, end = START, iter(()), START
        while ahead is not None and ahead[0] == conv:
            _, at, role, text, states, audits = ahead
            ahead = next(stream, None)
            if at < 0:
                left, end = iter(audits[q]), states[q]
                continue
            for e in left:
                if e == "I":
                    q = NEXT[q]
                    yield e, ROLE[q], ""
                    continue
                if e == "K":
                    q = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                elif e == "R":
                    q = NEXT[q]
                    role = ROLE[q]
                yield e, role, text
                break
            if ahead is None or ahead[0] != conv:      # what the last chunk inserts at the end
                for e in left:
                    q = NEXT[q]
                    yield e, ROLE[q], ""
        assert q == end

    while ahead is not None:
        conv = ahead[0]
        yield conv, edits(conv)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, found = None, []

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], kind), *(pa.array([f[k] for f in found], pa.string()) for k in (1, 2))],
            names=["conv_id", "audit", "repaired_sha256"])

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield batch

    for conv, edits in _conversations(typed()):
        audit, digest, empty = [], hashlib.sha256(), True
        for e, role, text in edits:
            audit.append(e)
            if e != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        found.append((conv, "".join(audit), digest.hexdigest()))
        if len(found) == 1_000:
            yield out()
            found = []
    if found:
        yield out()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, found, size = None, [], 0

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.int64()),
             *(pa.array([f[k] for f in found], pa.string()) for k in (2, 3, 4))],
            names=["conv_id", "place", "edit", "role", "text"])

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield batch

    for conv, edits in _conversations(typed()):
        place = 0
        for e, role, text in edits:
            if e != "D":
                found.append((conv, place, e, role, text))
                place, size = place + 1, size + len(text) + 50
                if size > 1 << 20:
                    yield out()
                    found, size = [], 0
    if found:
        yield out()


class Repair:
    """The repair of rows (conv_id, turn, role, text) in any columns' names.

    ``report()``: a row per conversation; ``rows()``: the repaired conversations.
    Both come from the same traces, which jobs compute when the object is made.
    """

    def __init__(self, df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", copy_col: str | None = None,
                 chunk: int = CHUNK):
        space = F.lit(" ")
        rows = df.select(
            F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
            (F.col(copy_col) if copy_col else F.lit(0)).alias("copy"))
        self.placed = placed(rows, chunk)
        self.flagged = checkpointed(faults(self.placed))
        chunks = converged(chunked(self.flagged))
        kind = df.schema[conv_col].dataType.simpleString()
        self.kind = kind
        self.traces = checkpointed(chunks.mapInArrow(
            _trace, f"gid long, conv_id {kind}, illegal long, constant long, at_start long, states array<int>, "
                    "audits array<string>"))

    def _stream(self, run, schema: str) -> DataFrame:
        rows = _numbered(self.placed.select("conv_id", "part", "chunk", "at", "role", "text"), self.flagged)
        rows = rows.select("conv_id", "gid", "at", "role", "text", F.lit(None).cast("array<int>").alias("states"),
                           F.lit(None).cast("array<string>").alias("audits"))
        none = F.lit(None).cast("string")
        heads = self.traces.select("conv_id", "gid", F.lit(-1).alias("at"), none.alias("role"), none.alias("text"),
                                   "states", "audits")
        return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "gid", "at").mapInArrow(
            run, schema)

    def rows(self) -> DataFrame:
        """(conv_id, place, edit, role, text): the repaired rows in order of ``place``."""
        return self._stream(_repaired, f"conv_id {self.kind}, place long, edit string, role string, text string")

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
        gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        counts = self.flagged.groupBy("conv_id").agg(
            F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
        costs = self.traces.groupBy(F.col("conv_id").alias("c1")).agg(
            F.sum("illegal").alias("illegal"),
            (F.sum("constant") + F.min(F.struct("gid", "at_start"))["at_start"]).alias("cost"))
        digests = self._stream(_digests, f"conv_id {self.kind}, audit string, repaired_sha256 string") \
            .withColumnRenamed("conv_id", "c2")
        return counts.join(costs, F.col("conv_id").eqNullSafe(F.col("c1"))).join(
            digests, F.col("conv_id").eqNullSafe(F.col("c2"))).select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


# ------------------------------------------------------------- the registered query

def damaged(conversations: DataFrame) -> DataFrame:
    """The table with the contract's damage; ``copy`` tells a repeated row from its
    original. Nulls count as one space."""
    space, text, role = F.lit(" "), F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key.cast("binary")) % 20
    copies = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.where(hit != 0).select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"))


def repair_report(table: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The contract's columns for every conversation of the undamaged table."""
    report = Repair(damaged(table), copy_col="copy", chunk=chunk).report().withColumnRenamed("conv_id", "c")
    ids = table.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(report, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(read_table(spark, sf_dir, "conversations"))


# Backward over the rows of each conversation; per state the least (cost, audit, lines).
SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ascii(s)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit
  FROM conversations, tab),
dam AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE hit <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM dam),
flt AS (
  SELECT *, z = '' AS blank, z <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
    lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM num),
rws AS (
  SELECT *, NOT blank AND NOT dup AND z NOT IN ('.', '!', '?') AS cut FROM flt),
cnt AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (following IS NOT NULL AND role[1] || following NOT IN ('su', 'ua', 'au')) AS illegal,
    count(*) AS n FROM rws GROUP BY conv_id),
dp AS (
  SELECT conv_id, n AS i, [{'c': 0, 'a': '', 't': []::VARCHAR[]}, {'c': 6, 'a': 'II', 't': ['user:', 'assistant:']},
    {'c': 3, 'a': 'I', 't': ['assistant:']}, {'c': 0, 'a': '', 't': []::VARCHAR[]}] AS b FROM cnt
  UNION ALL
  SELECT conv_id, i, [list_sort([o0, {'c': 3 + u.c, 'a': 'I' || u.a, 't': ['user:'] || u.t}])[1],
                      list_sort([o1, {'c': 3 + u.c, 'a': 'I' || u.a, 't': ['user:'] || u.t}])[1], u, s] AS b
  FROM (
    SELECT *, list_sort([o2, {'c': 3 + o3.c, 'a': 'I' || o3.a, 't': ['assistant:'] || o3.t}])[1] AS u,
      list_sort([o3, {'c': 3 + o2.c, 'a': 'I' || o2.a, 't': ['user:'] || o2.t}])[1] AS s
    FROM (
      SELECT conv_id, i, opt[1] AS o0, opt[2] AS o1, opt[3] AS o2, opt[4] AS o3
      FROM (
        SELECT d.conv_id, d.i - 1 AS i, list_transform(range(1, 5), lambda q: list_sort(list_filter([
          {'c': 4 + d.b[q].c, 'a': 'D' || d.b[q].a, 't': d.b[q].t},
          CASE WHEN NOT r.blank AND NOT r.dup THEN
            {'c': 3 + CASE WHEN r.cut THEN 3 ELSE 0 END + d.b[[3, 3, 4, 3][q]].c, 'a': 'R' || d.b[[3, 3, 4, 3][q]].a,
             't': [['user:', 'user:', 'assistant:', 'user:'][q] || r.text] || d.b[[3, 3, 4, 3][q]].t} END,
          CASE WHEN NOT r.blank AND NOT r.dup AND list_contains([['s', 'u'], ['u'], ['a'], ['u']][q], r.role[1]) THEN
            {'c': CASE WHEN r.cut THEN 3 ELSE 0 END + d.b[CASE r.role[1] WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c,
             'a': 'K' || d.b[CASE r.role[1] WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a,
             't': [r.role || ':' || r.text] || d.b[CASE r.role[1] WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].t} END],
          lambda x: x IS NOT NULL))[1]) AS opt
        FROM dp d JOIN rws r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i)))),
fin AS (SELECT conv_id, b[1].c AS cost, b[1].a AS audit, sha256(array_to_string(b[1].t, chr(10))) AS repaired_sha256
        FROM dp WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id
"""
