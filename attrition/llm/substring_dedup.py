"""Removal of repeated substrings with interval expansion on a BWT.

Every byte goes that is covered by a string of ``length`` bytes which also starts
anywhere else. At scale only a small rest of the corpus needs a suffix index:

1. Each window of ``length`` bytes has an anchor, its leftmost smallest gram of
   ``gram`` bytes by hash; windows in a row with the same anchor are a run. Equal
   windows have equal anchors. Equal runs met in one batch are known to repeat and
   need no shuffle by anchor; of these and all others one row each is dealt out.
2. Runs of one anchor meet. Equal runs repeat as a whole; a run alone with its
   anchor doesn't; runs that differ but share the anchor are compared in step 3,
   with one run standing for all that equal it.
3. The texts of such runs, in portions of whole anchor groups, get a suffix
   order and its Burrows-Wheeler transform. Sorting passes the intervals of
   common prefixes of over half of ``length`` on its way; from these, breadth-first
   backward extension finds those of one byte more, again and again. An interval
   of one suffix is dropped at once, and expansion stops at ``length``: what is
   left are windows that occur twice.
   Groups of more than ``GROUP`` runs are too large for one portion: their windows
   are counted in Spark, by the hashes of their anchor and of all their bytes.
4. Each document gets its intervals, and its remaining bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table
from .shingles import _BYTE, _powers, mix

LENGTH = 200
GRAM = 64
PART_BYTES = 1 << 18      # text that is scanned at once; a longer text goes in pieces
PORTION = 1 << 19         # text that gets one suffix order
GROUP = 8_192             # runs of one anchor in a portion (of 336 bytes at most, so under 3 MB)
PLACE = np.uint64((1 << 24) - 1)

RUN = "doc_id {id}, text_hash long, start long, windows long"


def _hashes(raw: np.ndarray) -> tuple:
    """What gives the hash of any substring: prefix sums and powers."""
    power, inverse = _powers(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * power[:len(raw)], dtype=np.uint64)])
    return total, inverse


def _leftmost_least(h: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost smallest value of each window of ``size`` values."""
    least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have * 2 <= size:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if size > have:
        least = np.minimum(least[:have - size], least[size - have:])
    return (least & PLACE).astype(np.int64)


def _runs(texts: list[tuple[int, int, bytes]], length: int, gram: int):
    """(owner, start, windows, anchor, run) arrays of texts (owner, offset, bytes)."""
    raw = np.frombuffer(b"".join(t for _, _, t in texts), np.uint8)
    ends = np.cumsum([0] + [len(t) for _, _, t in texts])
    if len(raw) < length:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    total, inverse = _hashes(raw)
    h = mix((total[gram:] - total[:-gram]) * inverse[:len(raw) - gram + 1])
    least = _leftmost_least(h, length - gram + 1)
    s = np.arange(len(least))
    which = np.searchsorted(ends, s, side="right") - 1
    inside = s + length <= ends[which + 1]
    s, which, least = s[inside], which[inside], least[inside]
    if not len(s):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (which[1:] != which[:-1])]))
    first, last = s[new], s[np.concatenate([new[1:] - 1, [len(s) - 1]])]
    end = last + length
    run = mix((total[end] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    owner = np.array([o for o, _, _ in texts])[which[new]]
    offset = np.array([x for _, x, _ in texts])[which[new]]
    return [owner, first - ends[which[new]] + offset, last - first + 1, h[least[new]], run]


def _cut(texts: list[bytes], length: int, limit: int):
    """Portions of (owner, offset, bytes); windows belong to one piece of a long text."""
    part, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), limit):
            piece = t[at:at + limit + length - 1]
            if part and size + len(piece) > 2 * limit:
                yield part
                part, size = [], 0
            part.append((i, at, piece))
            size += len(piece)
    if part:
        yield part


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of runs: route, run, times, text key, start, windows. Runs that are
    equal to another one of their batch have times 0 and a route of their own;
    one more row with times 2 and no text key stands for all of these."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            found = [_runs(p, length, gram) for p in _cut(texts, length, PART_BYTES)]
            if not found:
                continue
            owner, start, n, anchor, run = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((run, anchor))
            owner, start, n, anchor, run = (x[order] for x in (owner, start, n, anchor, run))
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])])[:len(run)]
            times = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(run) else np.zeros(0, np.int64)
            again, lead = times > 1, new & (times > 1)
            own = mix((start + owner * 7919).astype(np.uint64))
            route = np.concatenate([np.where(again, own, anchor), anchor[lead]]).view(np.int64)
            take = pa.array(np.concatenate([owner, owner[lead]]))
            extra = int(lead.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(route), pa.array(np.concatenate([run, run[lead]]).view(np.int64)),
                pa.array(np.concatenate([np.where(again, 0, 1), np.full(extra, 2)])),
                batch.column("doc_id").take(take), batch.column("text_hash").take(take),
                pa.array(np.concatenate([start, start[lead]])), pa.array(np.concatenate([n, n[lead]]))],
                names=["route", "run", "times", "doc_id", "text_hash", "start", "windows"])
    return docs.mapInArrow(scan, "route long, run long, times long, " + RUN.format(id=kind))


def _meet(rows: DataFrame) -> DataFrame:
    """Of the runs of every anchor: those that repeat (kind 0), those alone that
    must be compared (1) and one for each that repeats, to compare with (2).
    Streams over sorted rows and keeps at most two of an anchor."""
    names = ["kind", "anchor", "doc_id", "text_hash", "start", "windows"]
    kind = rows.schema["doc_id"].dataType

    def meet(batches: Iterator[pa.RecordBatch]):
        anchor = run = lead = None    # the run at hand and its first row
        repeats = mixed = False
        waiting = []                  # what the first run of an anchor emits if a second comes
        out = []

        def end_run():
            nonlocal waiting
            if lead is not None:
                row = ((2 if repeats else 1), anchor, *lead[1:])
                if mixed:
                    out.append(row)
                else:
                    waiting = [row]

        def table():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                pa.array(cols[2], ids), *[pa.array(c, pa.int64()) for c in cols[3:]]], names=names)

        for batch in batches:
            ids = batch.column("doc_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                a, r, times, rest = row[0], row[1], row[2], row[3:]
                if times == 0:
                    out.append((0, a, *rest))
                    continue
                if a != anchor:
                    end_run()
                    anchor, run, lead, repeats, mixed, waiting = a, r, (times, *rest), times > 1, False, []
                elif r != run:
                    end_run()
                    out += waiting
                    run, lead, repeats, mixed, waiting = r, (times, *rest), times > 1, True, []
                else:
                    if lead[0] == 1:      # what has times 2 is emitted already, as times 0
                        out.append((0, a, *lead[1:]))
                        lead = (0, *lead[1:])
                    if times == 1:
                        out.append((0, a, *rest))
                    repeats = True
            if len(out) > 20_000:
                yield table()
                out = []
        end_run()
        if out:
            yield table()

    return rows.repartition("route").sortWithinPartitions("route", "run").mapInArrow(
        meet, "kind long, anchor long, " + RUN.format(id=kind.simpleString()))


def _suffix_order(raw: np.ndarray, length: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(suffix array by the first ``length`` symbols or more, size, names): ``names`` tell,
    by suffix, which suffixes share their first ``size`` symbols, at least half of ``length``.

    Prefix doubling; a suffix that nothing else begins like any more keeps its place, so
    each round sorts only what is still alike.
    """
    n = len(raw)
    wide = np.concatenate([raw, np.zeros(6, raw.dtype)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | wide[k:k + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key, wide
    first = np.flatnonzero(new).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = first[np.cumsum(new) - 1]
    depth, seeds = 7, (1, raw.astype(np.int32)) if length < 7 else None
    while depth < length + 1:
        if depth * 2 >= length and seeds is None:
            seeds = (depth, rank.copy())
        alike = ~new | np.concatenate([~new[1:], [False]])
        at = np.flatnonzero(alike)                          # places whose suffix is like a neighbour's
        if not len(at):
            break
        own = order[at]
        behind = own + depth
        pair = rank[own].astype(np.int64) * (n + 1)
        inside = behind < n
        pair[inside] += rank[behind[inside]] + 1
        by = np.argsort(pair, kind="stable")
        own, pair = own[by], pair[by]
        order[at] = own
        lead = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[own] = at[np.flatnonzero(lead)][np.cumsum(lead) - 1]
        new[at] = lead
        depth *= 2
    return order, *(seeds or (depth, rank))


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of its windows of ``length`` bytes that occur more
    than once in all texts."""
    raw = np.concatenate([np.frombuffer(t + b"\0", np.uint8) for t in texts]).astype(np.uint16) + np.uint16(1)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    raw[ends - 1] = 0                       # the end of a text
    n = len(raw)
    order, size, names = _suffix_order(raw, length)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    after = place[np.minimum(order + 1, n - 1)]         # suffix without its first symbol
    symbol = raw[order]                                 # which backward extension puts before it
    # intervals of suffixes with a common prefix, of two suffixes or more
    interval = names[order]
    alive = np.arange(n)

    def expanded(alive: np.ndarray, name: np.ndarray, first: np.ndarray):
        same = (name[1:] == name[:-1]) & (first[1:] == first[:-1])
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        fresh = np.cumsum(np.concatenate([[True], ~same])) - 1
        return alive[keep], fresh[keep]

    alive, name = expanded(alive, interval, np.zeros(n, np.int8)) if n > 1 else (alive[:0], alive[:0])
    interval = np.full(n, -1, np.int32)
    interval[alive] = name
    # suffixes whose tail is alive may be alive one symbol longer
    while size < length and len(alive):
        tail = interval[after]
        old = alive
        alive = np.flatnonzero(tail >= 0) if len(alive) * 4 > n else np.sort(place[order[old][order[old] > 0] - 1])
        alive, name = expanded(alive, tail[alive], symbol[alive]) if len(alive) else (alive, alive)
        interval[old] = -1
        interval[alive] = name
        size += 1
    start = np.sort(order[alive])
    which = np.searchsorted(ends, start, side="right")
    begin = ends - sizes
    whole = start + length < ends[which]                # not over the end of a text
    start, which = start[whole], which[whole]
    return [x - b for x, b in zip(np.split(start, np.searchsorted(which, np.arange(1, len(texts)))), begin)]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(begin, end) of the bytes that windows at sorted starts cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(),
                    (starts[np.concatenate([gap, [len(starts) - 1]])] + length).tolist()))


def _compare(mixed: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text_hash, begin, end of repeated bytes in runs that stand alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    on = docs["doc_id"].eqNullSafe(mixed["doc_id"]) & (docs["text_hash"] == mixed["text_hash"])
    raw = F.col("text").cast("binary")
    rows = docs.join(mixed, on).select(
        "anchor", "kind", mixed["doc_id"], mixed["text_hash"], "start",
        F.expr(f"substring(cast(text AS binary), start + 1, windows + {length - 1})").alias("bytes")
    ).dropDuplicates(["anchor", "kind", "doc_id", "text_hash", "start"])

    def compare(batches: Iterator[pa.RecordBatch]):
        portion, group, size, now = [], [], 0, None
        large = False
        out = []

        def solve():
            nonlocal portion, size
            if len(portion) > 1:
                for row, starts in zip(portion, repeated_windows([r[5] for r in portion], length)):
                    if row[1] == 1:
                        out.extend((row[2], row[3], row[4] + a, row[4] + b, None, None) for a, b in _spans(starts, length))
            portion, size = [], 0

        def windows(rows):
            for r in rows:
                text = np.frombuffer(r[5], np.uint8)
                total, inverse = _hashes(text)
                m = len(text) - length + 1
                h = mix((total[length:length + m] - total[:m]) * inverse[:m]).view(np.int64).tolist()
                out.extend((r[2], r[3], r[4] + i, r[4] + i + length, r[0], x) if r[1] == 1 else
                           (r[2], None, r[4] + i, None, r[0], x) for i, x in enumerate(h))

        def end_group():
            nonlocal group, size, large
            if large:
                windows(group)
            else:
                if size + sum(len(r[5]) for r in group) > PORTION:
                    solve()
                portion.extend(group)
                size += sum(len(r[5]) for r in group)
            group, large = [], False

        def table():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], ids), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                names=["doc_id", "text_hash", "begin", "end", "anchor", "window"])

        ids = None
        for batch in batches:
            ids = batch.column("doc_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    end_group()
                    now = row[0]
                group.append(row)
                if len(group) >= GROUP:
                    windows(group)
                    group, large = [], True
                if len(out) > 100_000:
                    yield table()
                    out = []
        end_group()
        solve()
        if out:
            yield table()

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        compare, f"doc_id {kind}, text_hash long, begin long, end long, anchor long, window long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, begin, end of bytes that repeated windows cover; spans
    may overlap. ``docs`` has doc_id, text, text_hash. Runs jobs when called."""
    spark = docs.sparkSession
    path = new_path(spark, "runs")
    _meet(_anchored(docs, length, gram)).write.parquet(path)
    runs = spark.read.parquet(path)
    whole = runs.where("kind = 0").select(
        "doc_id", "text_hash", F.col("start").alias("begin"),
        (F.col("start") + F.col("windows") + F.lit(length - 1)).alias("end"))
    path = new_path(spark, "compared")
    _compare(runs.where("kind > 0"), docs, length).write.parquet(path)
    found = spark.read.parquet(path)
    counted = found.where("window IS NOT NULL")
    # equal in the hashes of anchor and window, 128 bits in all
    again = counted.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return whole.unionByName(found.where("window IS NULL").drop("anchor", "window")).unionByName(
        counted.where("text_hash IS NOT NULL").join(again, ["anchor", "window"]).drop("anchor", "window"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and kept, the
    remaining bytes. (A cut may fall inside a character, so they are binary.)

    A null text counts as empty; texts under ``length`` bytes are kept whole;
    equal texts of that length or more go wholly, all of them, as each repeats
    in the other. Rows that repeat an id are judged by their own texts. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(
        F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))
    spans = repeated_spans(rows, length, gram).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))  # those of one text
    s = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    joined = rows.join(s, rows["doc_id"].eqNullSafe(s["_id"]) & (rows["text_hash"] == s["_hash"]), "left")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes, removed, spans_, kept = [], [], [], []
            spans = batch.column("spans")
            for i, text in enumerate(batch.column("text")):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                at, parts, n = 0, [], 0
                for x in spans[i].as_py() or []:
                    if x["begin"] > at or not n:
                        parts.append(raw[at:x["begin"]])
                        n += 1
                    at = max(at, x["end"])
                parts.append(raw[at:])
                left = b"".join(parts)
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                spans_.append(n)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans_, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return joined.select("doc_id", "text", "spans").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
