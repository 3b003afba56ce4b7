"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of vocabulary pieces; a segmentation's score is the sum of
its pieces' scores. Forward Viterbi scores are the exact best score of every
prefix, so a backward A* search which uses them as heuristic meets the N best
segmentations in order. No piece holds a word mark or a line break behind its first
character, so the lattice of a text is a chain of the lattices of its words: the
best path is the chain of the words' best paths, and the N best differ from it
only in the N - 1 words whose second path costs least.

Viterbi runs over all new words of a batch at once (numpy); a word of more than
``LONG`` characters (base64, a page without blanks) goes alone, in time and memory in
proportion to its length. A* runs for the few words that an N-best list needs: entries
are links to the entry they came from, of equal ones that nearest to the goal goes
first, and no place is expanded more than N times, as no later visit can be among the
N best. Results are kept for the words seen last.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
BATCH_CHARS = 1 << 17     # characters that are encoded at once
LEARN_CHARS = 1 << 15     # characters of words that go through Viterbi at once
CACHE_WORDS = 400_000     # words whose best paths a Python worker keeps
CACHE_CHARS = 1 << 22     # and their characters
CACHE_LISTS = 10_000      # words whose N-best lists it keeps
LONG = 512                # characters from which a word goes alone and has no list kept

MARK = "▁"           # stands for a blank
NEVER = -1e8              # longer pieces below this score are in no segmentation
UNKNOWN = 10.0            # a byte costs this much more than the worst piece
LATIN = "A-Za-z\u00c0-\u024f"
PUNCT = r"!-/:-@\[-`{-~"  # ASCII punctuation
#: Words: a mark begins one and a line break is one; where no piece has
#: punctuation behind a Latin letter, such a place ends one too.
COARSE = re.compile(f"{MARK}[^{MARK}\n]*|[^{MARK}\n]+|\n")
FINE = re.compile(f"{MARK}?(?:[{LATIN}]++(?=[{PUNCT}])|(?:[^{MARK}\n{LATIN}]|[{LATIN}]++(?![{PUNCT}]))++"
                  f"(?:[{LATIN}]++(?=[{PUNCT}]))?)|{MARK}|\n")
BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces, scores and byte ids of a model file, and cached paths of words."""

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
        scores = [m.get_score(i) for i in range(m.vocab_size())]
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
                   for i in range(m.vocab_size())]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if m.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode("utf-8", "surrogatepass")
                    for i, p in enumerate(self.pieces)]
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte pieces, so it can't encode every text")
        # a lone character is always a piece; scored as never, it costs as the worst of the others
        worst = min(s for s, x in zip(scores, special) if not x and s > NEVER)
        use = {i: max(s, worst) for i, s in enumerate(scores)
               if not special[i] and (s > NEVER or len(self.pieces[i]) == 1)}
        self.byte_score = worst - UNKNOWN
        self.score = {self.pieces[i]: (s, i) for i, s in use.items()
                      if not set(self.pieces[i][1:]) & {MARK, "\n"}}
        self.longest = max(map(len, self.score))
        mixed = re.compile(f"[{LATIN}][{PUNCT}]")
        self.words = (COARSE if any(mixed.search(p) for p in self.score) else FINE).findall
        self.tables = []
        for n in range(1, self.longest + 1):
            own = [(p, s, i) for p, (s, i) in self.score.items() if len(p) == n]
            keys = np.array([_hash(np.array([ord(c) for c in p], np.uint64)) for p, _, _ in own], np.uint64)
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array([s for _, s, _ in own])[order],
                                np.array([i for _, _, i in own], np.int32)[order]))
        self.clear()

    def clear(self) -> None:
        self.at, self.lists = {}, {}
        self.n_words = self.n_chars = 0
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.best, self.gap = np.zeros(0), np.zeros(0)

    def into(self, word: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The edges that end at a place of the word's lattice: start, score, ids; the
        shortest first."""
        out = []
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            got = self.score.get(word[start:end])
            if got:
                out.append((start, got[0], (got[1],)))
            elif start == end - 1:
                raw = word[start].encode("utf-8", "surrogatepass")
                out.append((start, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)))
        return out

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end of the word's lattice its edges."""
        return [[], *(self.into(word, end) for end in range(1, len(word) + 1))]

    def path(self, word: str) -> tuple[list[int], float, float]:
        """Best ids of a word, their score and that of the second best path (or -inf)."""
        one, two, back = [0.0], [-np.inf], [(0, ())]
        for end in range(1, len(word) + 1):
            a = b = -np.inf
            step = None
            for start, x, own in self.into(word, end):
                c, d = one[start] + x, two[start] + x
                if c > a:
                    a, b, step = c, max(a, d), (start, own)
                else:
                    b = max(b, c, d)
            one.append(a)
            two.append(b)
            back.append(step)
        at, parts = len(word), []
        while at:
            at, own = back[at]
            parts.append(own)
        return [i for own in reversed(parts) for i in own], one[-1], two[-1]

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a word with their scores, best first.

        Of equal scores the one comes first whose last pieces are the longest.
        """
        if (word, n) in self.lists:
            return self.lists[word, n]
        forward = [0.0]
        for end in range(1, len(word) + 1):
            forward.append(max(forward[s] + x for s, x, _ in self.into(word, end)))
        visits = [0] * (len(word) + 1)
        # entries: minus the score of the best path through, place, number, score behind, ids of the edge, next entry
        count = itertools.count()
        heap, out = [(-forward[-1], len(word), next(count), 0.0, (), None)], []
        while heap and len(out) < n:
            entry = heapq.heappop(heap)
            _, at, _, behind, _, _ = entry
            if visits[at] == n:
                continue
            visits[at] += 1
            if at == 0:
                ids = []
                while entry is not None:
                    ids.extend(entry[4])
                    entry = entry[5]
                out.append((behind, tuple(ids)))
                continue
            for start, score, own in self.into(word, at):
                if visits[start] < n:
                    heapq.heappush(heap, (-(forward[start] + score + behind), start, next(count), behind + score,
                                          own, entry))
        if len(word) <= LONG:
            self.lists[word, n] = out
        return out

    def learn(self, words: list[str]) -> None:
        """Best path, its score and the distance to the second one of new words."""
        for w in [w for w in words if len(w) > LONG]:
            ids, best, second = self.path(w)
            self._keep([w], np.array(ids, np.int32), np.array([len(ids)]), np.array([best]), np.array([best - second]))
        words = sorted((w for w in words if len(w) <= LONG), key=len, reverse=True)
        sizes = np.cumsum([len(w) for w in words])
        cuts = np.searchsorted(sizes, np.arange(LEARN_CHARS, sizes[-1] if len(words) else 0, LEARN_CHARS)).tolist()
        for a, z in zip([0, *cuts], [*cuts, len(words)]):
            if a < z:
                self._learn(words[a:z])

    def _learn(self, words: list[str]) -> None:
        """Viterbi over all words at once, which come longest first."""
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        room = np.repeat(first + size, size) - np.arange(len(chars))  # to the word's end
        score = np.full((self.longest, len(chars)), -np.inf)
        piece = np.full((self.longest, len(chars)), -1, np.int32)
        key = np.zeros(len(chars), np.uint64)
        spots = np.arange(len(chars))
        for n, (keys, scores, ids) in enumerate(self.tables, 1):
            spots = spots[room[spots] >= n]
            if not len(spots):
                break
            key[spots] = (key[spots] + chars[spots + n - 1] + np.uint64(1)) * BASE
            if len(keys):
                near = np.minimum(np.searchsorted(keys, key[spots]), len(keys) - 1)
                hit = keys[near] == key[spots]
                score[n - 1, spots[hit]] = scores[near[hit]]
                piece[n - 1, spots[hit]] = ids[near[hit]]
        odd = np.flatnonzero(piece[0] < 0)
        n_bytes = 1 + (chars[odd] > 0x7F).astype(np.int64) + (chars[odd] > 0x7FF) + (chars[odd] > 0xFFFF)
        score[0, odd] = self.byte_score * n_bytes
        # two best scores at every end; arrays have one place more for each word
        place = first + np.arange(len(words))
        one, two = np.full(len(chars) + len(words), -np.inf), np.full(len(chars) + len(words), -np.inf)
        back = np.zeros(len(chars) + len(words), np.int64)
        one[place] = 0.0
        longest = int(size[0])
        alive = np.searchsorted(-size, -np.arange(longest + 2), side="right")  # words of at least so many characters
        sizes = np.arange(1, self.longest + 1)[:, None]
        scores, rows, cols = score.ravel(), (sizes - 1) * len(chars), np.arange(len(words))
        for end in range(1, longest + 1):
            w, n = alive[end], sizes[:end]
            x = scores[rows[:end] + (first[:w] + end - n)]   # of the pieces of n characters that end here
            start = place[:w] + end - n
            c, d = one[start] + x, two[start] + x
            step = c.argmax(axis=0)
            here = place[:w] + end
            one[here], back[here] = c[step, cols[:w]], step + 1
            c[step, cols[:w]] = -np.inf
            two[here] = np.maximum(c.max(axis=0), d.max(axis=0))
        # walk back along the best paths, all words at once
        at, who, steps = size.copy(), np.arange(len(words)), []
        while len(who):
            n = back[place[who] + at[who]]
            at[who] -= n
            steps.append((who, at[who].copy(), piece[n - 1, first[who] + at[who]], first[who] + at[who]))
            who = who[at[who] > 0]
        owner, start, got, spot = (np.concatenate(x) for x in zip(*steps))
        raw = np.flatnonzero(got < 0)
        if len(raw):
            more = [[self.byte_ids[b] for b in chr(int(chars[spot[i]])).encode("utf-8", "surrogatepass")]
                    for i in raw]
            extra = np.array([len(m) for m in more]) - 1
            times = np.ones(len(got), np.int64)
            times[raw] += extra
            owner, start = np.repeat(owner, times), np.repeat(start, times)
            flat = np.repeat(got, times)
            flat[flat < 0] = [i for m in more for i in m]
            got = flat
        order = np.lexsort((start, owner))
        got, n_ids = got[order], np.bincount(owner, minlength=len(words))
        if self.join(got.tolist()) != text:
            raise ValueError("two pieces share a key")
        last = place + size
        self._keep(words, got, n_ids, one[last], one[last] - two[last])

    def _keep(self, words: list[str], ids: np.ndarray, n_ids: np.ndarray, best: np.ndarray, gap: np.ndarray) -> None:
        for i, w in enumerate(words):
            self.at[w] = self.n_words + i
        self.n_words += len(words)
        self.n_chars += sum(map(len, words))
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(n_ids)])
        self.best = np.concatenate([self.best, best])
        self.gap = np.concatenate([self.gap, gap])

    def join(self, ids) -> str:
        """The pieces of ids in a row; runs of bytes are read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.pieces.__getitem__, ids))
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


def _hash(chars: np.ndarray) -> np.uint64:
    key = np.zeros(1, np.uint64)
    for c in chars:
        key = (key + c + np.uint64(1)) * BASE
    return key[0]


def marked(text: str) -> str:
    """Blanks become marks, and a text that isn't empty begins with one."""
    return MARK + text.replace(" ", MARK) if text else ""


def _lowest_sums(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n lowest sums of one number from each ascending list that begins with 0,
    and the places of these numbers."""
    sums = [(0.0, ())]
    for x in lists:
        sums = sorted(((a + b, (*p, k)) for a, p in sums for k, b in enumerate(x)), key=lambda s: s[0])[:n]
    return sums


def encoded(v: Vocabulary, texts: list[str], n: int) -> tuple[list, list, list, list]:
    """For each text its best ids, their score, the scores of its n best segmentations
    and how these differ from the best: lists of (place in ids, number of ids, other ids)."""
    if v.n_words > CACHE_WORDS or v.n_chars > CACHE_CHARS:
        v.clear()
    if len(v.lists) > CACHE_LISTS:
        v.lists = {}
    words = [v.words(marked(t)) for t in texts]
    places = [np.fromiter(map(v.at.get, own, itertools.repeat(-1)), np.int64, len(own)) for own in words]
    missing = [np.flatnonzero(at < 0) for at in places]
    new = {own[i] for own, some in zip(words, missing) for i in some}
    if new:
        v.learn(sorted(new))
    for own, at, some in zip(words, places, missing):
        at[some] = [v.at[own[i]] for i in some]
    all_ids, best, lists, edits = [], [], [], []
    for own, at in zip(words, places):
        n_ids = v.begin[at + 1] - v.begin[at]
        ends = np.cumsum(n_ids)
        total = int(ends[-1]) if len(own) else 0
        take = np.repeat(v.begin[at] - ends + n_ids, n_ids) + np.arange(total)
        all_ids.append(v.ids[take])
        score = float(v.best[at].sum())
        gaps = v.gap[at]
        near = np.argsort(gaps, kind="stable")[:n - 1] if len(own) < 4 * n else np.argpartition(gaps, n)[:n]
        near = sorted(near, key=lambda i: (gaps[i], i))[:n - 1]
        costs, others = [], []
        for i in near:
            if np.isfinite(gaps[i]):
                got = v.n_best(own[i], n)
                first = tuple(v.ids[v.begin[at[i]]:v.begin[at[i] + 1]].tolist())
                rest = [x for x in got if x[1] != first][:n - 1]
                costs.append([0.0] + [got[0][0] - s for s, _ in rest])
                others.append((int(ends[i] - n_ids[i]), int(n_ids[i]), [None] + [list(x) for _, x in rest]))
        sums = _lowest_sums(costs, n)
        best.append(score)
        lists.append([score - x for x, _ in sums])
        edits.append([[(place, size, ids[k]) for (place, size, ids), k in zip(others, picks) if k]
                      for _, picks in sums])
    return all_ids, best, lists, edits


def encode_texts(v: Vocabulary, texts: list[str], n: int) -> tuple[list, list, list]:
    """Best ids, scores and scores of the n best segmentations."""
    return encoded(v, texts, n)[:3]


def edited(ids: list[int], changes) -> list[int]:
    """The ids of one of the n best segmentations, from the best and its changes."""
    out = list(ids)
    for place, size, other in sorted(changes, reverse=True):
        out[place:place + size] = other
    return out


def segmentations(v: Vocabulary, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a text in full, best first."""
    paths = [(0.0, ())]
    for word in v.words(marked(text)):
        paths = heapq.nlargest(n, ((s + t, a + b) for s, a in paths for t, b in v.n_best(word, n)),
                               key=lambda x: (x[0], -len(x[1])))
    return [(s, list(ids)) for s, ids in paths]


def decode_ids(v: Vocabulary, ids) -> str:
    """The text of ids: marks become blanks, the one at the start goes."""
    return v.join(ids).replace(MARK, " ").removeprefix(" ")


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary for each Python worker and model."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(model)
    return _LOADED[key]


def _model_bytes(path: str) -> bytes:
    """The model file; the driver reads it and sends it along with the tasks."""
    with open(os.path.expanduser(path), "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, n_best: int = N_BEST, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_pieces, score, nbest_scores, nbest_changes, lossless for every row of ``docs``.

    ``ids`` is the best segmentation and ``score`` its score; ``nbest_scores``
    those of the ``n_best`` best, fewer if the text has fewer, and ``nbest_changes`` how
    their ids differ from the best (``edited`` puts them together). ``lossless`` says
    that decoding gives the text again, which fails only for texts with the
    mark U+2581. Null and empty texts have no pieces, score 0 and one
    segmentation. Characters without a piece are spelt in bytes. Whole texts are
    encoded, of any length; other columns are ignored. Lowers the session's Arrow batches
    (``small_batches``).
    """
    raw = _model_bytes(model)
    changes = pa.list_(pa.list_(pa.struct([("place", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(raw)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            done = 0
            while done < len(batch):
                some, chars = [], 0
                while done + len(some) < len(batch) and (not some or chars < BATCH_CHARS):
                    some.append(texts[done + len(some)].as_py() or "")
                    chars += len(some[-1])
                got, best, lists, edits = encoded(v, some, n_best)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                tops = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(done, len(some)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got).astype(np.int32))),
                    pa.array(np.diff(ends).astype(np.int32)), pa.array(np.array(best)),
                    pa.ListArray.from_arrays(pa.array(tops), pa.array(np.concatenate(lists))),
                    pa.array([[[dict(zip(("place", "size", "ids"), c)) for c in k] for k in e] for e in edits], changes),
                    pa.array([decode_ids(v, x.tolist()) == t for x, t in zip(got, some)]),
                ], names=["doc_id", "ids", "n_pieces", "score", "nbest_scores", "nbest_changes", "lossless"])
                done += len(some)
        pa.default_memory_pool().release_unused()  # idle workers keep what they hold

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces int, score double, "
                                "nbest_scores array<double>, nbest_changes array<array<struct<place: int, size: int, "
                                "ids: array<int>>>>, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with ids; null ids give the empty text."""
    raw = _model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(raw)
        for batch in batches:
            texts = [decode_ids(v, x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))
