"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

#: A graph whose longest path is 2 ** n needs about n rounds; this is far beyond any that fits a cluster.
MAX_ROUNDS = 60
#: A graph of at most this many links (3 MB) is joined by one task; a larger one by all.
FEW_LINKS = 200_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` of the links' nodes and their roots, by union-find."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        above.setdefault(x, x)
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``: root is the smallest node that can be reached.

    Beyond ``few`` links, each round is two aggregations and two joins on the node; the links are written to the shared folder each round.
    Stars end as pairs (node, root), and a round that changes nothing is the last.
    """
    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    if now.count() <= few:
        return written(now.coalesce(1).mapInArrow(joined, "node long, root long"), "roots")
    before = None
    for _ in range(MAX_ROUNDS):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        step = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        last, now = now, written(step.where("a <> b").distinct(), "links")
        dropped(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
