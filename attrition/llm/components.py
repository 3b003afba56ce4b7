"""Connected components of links.

Links are contracted where they lie: a task takes ``PORTION`` of them at a time and
leaves, by union-find, one edge from each node to the smallest node it reaches there.
What spans portions is joined by alternating large and small stars, whose result
is contracted again; rounds end when nothing changes, or after the first contraction
if one portion held all links. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

PORTION = 1 << 17        # links that a task holds at a time


def _contracted(batches: Iterator[pa.RecordBatch], portion: int) -> Iterator[pa.RecordBatch]:
    up: dict = {}
    held, kind = 0, None

    def root(x):
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def stars():
        ends = [(x, root(x)) for x in list(up)]
        ends = [e for e in ends if e[0] != e[1]]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], kind) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            if x != y:
                up[max(x, y)] = min(x, y)
            held += 1
            if held == portion:
                yield stars()
                up, held = {}, 0
    if held:
        yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, portion: int = PORTION) -> DataFrame:
    """(node, component) of all nodes of links (a, b); a component is named by its
    smallest node. Links of a node with itself don't count; no links, no rows."""
    kind = links.schema["a"].dataType.simpleString()

    def contract(edges: DataFrame, n: int) -> DataFrame:
        return checkpointed(edges.coalesce(max(1, -(-n // portion))).mapInArrow(
            lambda batches: _contracted(batches, portion), f"a {kind}, b {kind}"))

    edges = checkpointed(links.where("a <> b").select("a", "b"))
    n, before = edges.count(), None
    while n:
        one = n <= portion
        edges = contract(edges, n)
        if one:
            break
        edges = checkpointed(_star(_star(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
