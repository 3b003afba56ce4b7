"""Word shingles of texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

PART_BYTES = 1 << 18   # text that is hashed at once; a longer text goes alone

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * PART_BYTES)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]),
                                     dtype=np.uint64) for x in (_ODD, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _parts(texts: list[str | None]):
    part, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
        if part and size + len(raw) > PART_BYTES:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield part


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted and without repeats (``np.unique`` fills a hash table first, at three times the cost)."""
    hashes = np.sort(hashes)
    new = hashes[1:] != hashes[:-1]
    return hashes if new.all() else hashes[np.concatenate([[True], new])]


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of ``words``
    words; of a shorter text the hash of all its words; none without words."""
    out: list[np.ndarray] = []
    for part in _parts(texts):
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        ends_of = np.cumsum([len(p) + 1 for p in part])
        space = _SPACE[raw]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _powers(len(raw) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * power[:len(raw)], dtype=np.uint64)])
        word = mix((total[end] - total[start]) * inverse[start])
        last = np.searchsorted(start, ends_of)           # words before the end of each text
        grams = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            grams = grams * _ODD + word[k:k + len(grams)]
        grams, at = mix(grams), 0
        for stop in last:
            n = stop - at
            if n >= words:
                out.append(_distinct(grams[at:stop - words + 1]))
            elif n:
                h = np.uint64(n)
                for w in word[at:stop]:
                    h = np.uint64((int(h) * int(_ODD) + int(w)) & 0xFFFFFFFFFFFFFFFF)
                out.append(mix(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at = stop
    return out
