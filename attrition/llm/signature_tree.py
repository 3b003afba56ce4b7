"""Signature trees over sets: which pairs may overlap enough?

Every set has a bitmap of its hashed tokens whose width goes by the size of the
set. A node holds the OR of its members' bitmaps, the range of their sizes and
their largest slack (tokens less set bits). Two nodes may hold a linked pair
only if their size ranges allow it and the bits they share, with the slack, can
cover the overlap that a link needs. Two trees, or one with itself, are walked
together from the top; whatever survives down to the leaves is a candidate pair. Similarities of 50 % or more are supported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .shingles import mix

BITS_PER_TOKEN = 2
SALT = np.uint64(0x5851F42D4C957F2D)


def width(n: int) -> int:
    """Bits of the bitmap of n tokens, a power of two."""
    return max(64, 1 << (BITS_PER_TOKEN * n - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    """The bitmap of a set of 64-bit hashes, little-endian."""
    w = width(len(tokens))
    bits = np.zeros(w, bool)
    bits[(mix(tokens ^ SALT) & np.uint64(w - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(bits: int, w: int) -> int:
    return (bits >> (w // 2)) | (bits & ((1 << (w // 2)) - 1))


@dataclass(slots=True)
class Node:
    lo: int                      # smallest and largest size of a member
    hi: int
    w: int                       # width of the bitmap
    bits: int
    slack: int                   # most tokens of a member beyond its set bits
    half: int                    # the same at half the width
    half_slack: int
    children: tuple              # two nodes, or none
    item: int                    # of an inner node that of its first leaf
    one: bool = False            # its items are known to be in one group (``joined``)

    @staticmethod
    def leaf(item: int, n: int, raw: bytes) -> Node:
        bits, w = int.from_bytes(raw, "little"), 8 * len(raw)
        half = _fold(bits, w)
        return Node(n, n, w, bits, n - bits.bit_count(), half, n - half.bit_count(), (), item, True)

    @staticmethod
    def over(a: Node, b: Node) -> Node:
        return Node(min(a.lo, b.lo), max(a.hi, b.hi), a.w, a.bits | b.bits, max(a.slack, b.slack),
                    a.half | b.half, max(a.half_slack, b.half_slack), (a, b), a.item)


def trees(items: list[tuple[int, bytes]], first: int = 0) -> list[Node]:
    """One tree for each bitmap width; ``items`` are (size, bitmap) in an order
    that has similar sets beside each other, and numbered from ``first``."""
    by_width: dict[int, list[Node]] = {}
    for i, (n, raw) in enumerate(items, first):
        by_width.setdefault(8 * len(raw), []).append(Node.leaf(i, n, raw))
    out = []
    for w in sorted(by_width):
        level = by_width[w]
        while len(level) > 1:
            level = [Node.over(*level[k:k + 2]) if k + 1 < len(level) else level[k]
                     for k in range(0, len(level), 2)]
        out.append(level[0])
    return out


def may_link(a: Node, b: Node, percent: int) -> bool:
    """Whether a member of a and one of b can have a Jaccard similarity of
    ``percent`` / 100 or more, by sizes and bitmaps alone."""
    if 100 * a.hi < percent * b.lo or 100 * b.hi < percent * a.lo:
        return False
    # a linked pair's sizes are at least these, and so is the overlap it needs
    least_a, least_b = max(a.lo, -(-percent * b.lo // 100)), max(b.lo, -(-percent * a.lo // 100))
    need = -(-percent * (least_a + least_b) // (100 + percent))
    if a.w == b.w:
        x, y, sa, sb = a.bits, b.bits, a.slack, b.slack
    elif a.w == 2 * b.w:
        x, y, sa, sb = a.half, b.bits, a.half_slack, b.slack
    elif b.w == 2 * a.w:
        x, y, sa, sb = a.bits, b.half, a.slack, b.half_slack
    else:
        return False                                # sizes differ by more than a factor of 2
    return (x & y).bit_count() + (sa if sa < sb else sb) >= need


def walk(a: Node, b: Node, percent: int, skip=None) -> Iterator[tuple[int, int]]:
    """Candidate pairs (item of a, item of b); of a tree with itself each pair once.
    ``skip(a, b)`` may rule out node pairs that need no answer any more."""
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if p is q:
            if p.children:
                x, y = p.children
                todo += [(x, y), (y, y), (x, x)]
            continue
        if not may_link(p, q, percent) or (skip and skip(p, q)):
            continue
        if not p.children and not q.children:
            yield p.item, q.item
        elif p.children and (not q.children or p.hi - p.lo >= q.hi - q.lo):
            todo += [(x, q) for x in p.children]
        else:
            todo += [(p, x) for x in q.children]


def candidates(forest: list[Node], percent: int, skip=None) -> Iterator[tuple[int, int]]:
    """All candidate pairs among the items of a forest."""
    for i, a in enumerate(forest):
        for b in forest[i:]:
            if b.w <= 2 * a.w:
                yield from walk(a, b, percent, skip)


def between(left: list[Node], right: list[Node], percent: int, skip=None) -> Iterator[tuple[int, int]]:
    """All candidate pairs of an item of one forest and one of another."""
    for a in left:
        for b in right:
            yield from walk(a, b, percent, skip)


def joined(root):
    """For ``skip``: pairs of nodes whose items ``root`` (of an item) has in one group already,
    as far as is known. Inside a tree the pairs of a node's own items come before
    those with its sibling, so its children have their marks by then."""
    def one(p: Node) -> bool:
        if not p.one and p.children[0].one and p.children[1].one:
            p.one = root(p.children[0].item) == root(p.children[1].item)
        return p.one

    def skip(p: Node, q: Node) -> bool:
        a, b = one(p), one(q)
        return a and b and root(p.item) == root(q.item)
    return skip
