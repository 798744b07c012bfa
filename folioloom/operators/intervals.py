"""Ranges, nested blocks and points on one line (byte places of a page): balance, enclosing blocks, what lies between, closure, most overlap.

All of it is as-of lookups: points and marks are put in one order and each point sees the last mark before it (or the first
behind it), so nothing is compared by inequality and no pairs of a page are made. ``by`` names the page's columns; a page, or
one nesting level of it, is the largest group.

Marks are rows ``(<by>, at, op)``: open, close, matrix or clip; other kinds are ignored. Ranges are ``(<by>, id, start, end)``, the end not included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Fixed value: rounds of a closure.
ROUNDS = 32


def looked_up(points: DataFrame, marks: DataFrame, by: list[str], at: str, value: Column, name: str, behind: bool = False, same: bool = False) -> DataFrame:
    """``points`` with ``name``: ``value`` of the last of ``marks (<by>, at)`` before each point's ``at`` (or the first ``behind`` it; ``same``: a mark at the same place counts), else null.

    ``by`` of a point may hold nulls, which meet no mark.
    """
    kind = marks.select(value.alias("v")).schema["v"].dataType
    rows = points.select(*by, F.col(at).alias("_at"), F.lit(1 if same else 0).alias("_turn"), F.struct("*").alias("_row"), F.lit(None).cast(kind).alias("_v"))
    seen = marks.select(*by, F.col("at").alias("_at"), F.lit(0 if same else 1).alias("_turn"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), value.alias("_v"))
    order = W.partitionBy(*by).orderBy(F.col("_at").desc() if behind else F.col("_at"), "_turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = rows.unionByName(seen).withColumn("_v", F.last("_v", ignorenulls=True).over(order))
    return met.where("_row is not null").select("_row.*", F.col("_v").alias(name))


def running(marks: DataFrame, by: list[str]) -> DataFrame:
    """``marks`` with sum (opens less closes so far) and depth (the same, but a close without an open counts for nothing)."""
    order = W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("op") == "open", 1).when(F.col("op") == "close", -1).otherwise(0)
    rows = marks.withColumn("sum", F.sum(step).over(order))
    return rows.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(order), F.lit(0)))


def blocks(marks: DataFrame, by: list[str]) -> DataFrame:
    """``(<by>, level, open, close, holds_clip)``: each close with its open. At one level opens and closes take turns, so neighbours are pairs; what has no partner is none.

    level is 1 for outermost blocks; holds_clip: a clip lies between.
    """
    rows = running(marks, by).where("op in ('open', 'close')")
    before = F.col("depth") + F.when(F.col("op") == "close", 1).otherwise(0)
    lost = (F.col("op") == "close") & (F.lag("depth", 1, 0).over(W.partitionBy(*by).orderBy("at")) == 0)
    rows = rows.withColumns({"level": before, "lost": lost}).where("not lost")
    order = W.partitionBy(*by, "level").orderBy("at")
    paired = rows.withColumns({"then": F.lead("op").over(order), "close": F.lead("at").over(order)}).where("op = 'open' and then = 'close'")
    paired = paired.select(*by, "level", F.col("at").alias("open"), "close")
    clips = marks.where("op = 'clip'").select(*by, "at")
    found = looked_up(paired, clips, by, "open", F.col("at"), "clip", behind=True)
    return found.withColumn("holds_clip", F.coalesce(F.col("clip") < F.col("close"), F.lit(False))).drop("clip")


def balanced(ranges: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """``ranges`` with balanced: inside, no close comes before its open, as many close as open, and no matrix stands at the range's own level.

    The first close that would go below the level at the start, and the first matrix at it, are looked up by level.
    """
    seen = running(marks, by).withColumn("level", F.col("sum").cast("long"))
    rows = looked_up(ranges, seen, by, "start", F.col("level"), "base")
    rows = looked_up(rows, seen, by, "end", F.col("level"), "last")
    rows = rows.withColumns({"base": F.coalesce("base", F.lit(0)), "last": F.coalesce("last", F.lit(0))})
    keyed = [*by, "level"]
    rows = looked_up(rows.withColumn("level", F.col("base") - 1), seen.where("op = 'close'"), keyed, "start", F.col("at"), "fall", behind=True, same=True)
    rows = looked_up(rows.withColumn("level", F.col("base")), seen.where("op = 'matrix'"), keyed, "start", F.col("at"), "matrix", behind=True, same=True)
    clear = lambda c: F.coalesce(F.col(c) >= F.col("end"), F.lit(True))
    return rows.withColumn("balanced", (F.col("base") == F.col("last")) & clear("fall") & clear("matrix")).drop("base", "last", "level", "fall", "matrix")


def between(ranges: DataFrame, points: DataFrame, by: list[str], start: str, end: str, name: str) -> DataFrame:
    """``ranges`` with ``name``: how many of ``points (<by>, at)`` lie from ``start`` to ``end`` (not included); none where the range is empty or open at a side."""
    so_far = points.select(*by, "at", F.row_number().over(W.partitionBy(*by).orderBy("at")).cast("long").alias("k"))
    rows = looked_up(ranges, so_far, by, start, F.col("k"), "_low")
    rows = looked_up(rows, so_far, by, end, F.col("k"), "_high")
    n = F.coalesce("_high", F.lit(0)) - F.coalesce("_low", F.lit(0))
    return rows.withColumn(name, F.when(F.col(start) < F.col(end), n).otherwise(0).cast("long")).drop("_low", "_high")


def _around(rows: DataFrame, known: DataFrame, by: list[str], at: str) -> DataFrame:
    """``rows`` once for each level of the blocks open at ``at``, with that level's last ``block`` opened before it (struct open, close, holds_clip)."""
    opened = looked_up(rows, known.withColumn("at", F.col("open")), by, at, F.col("level"), "_last")
    # the last block opened before a place is inside no more than one further level
    levels = opened.withColumn("level", F.explode(F.sequence(F.lit(1), F.coalesce("_last", F.lit(0)) + 1))).drop("_last").withColumn("level", F.col("level").cast("long"))
    found = looked_up(levels, known.select(*by, F.col("level").cast("long").alias("level"), F.col("open").alias("at"), F.struct("open", "close", "holds_clip").alias("block")), [*by, "level"], at, F.col("block"), "block")
    return found.where("block is not null")


def enclosing(ranges: DataFrame, marks: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """``ranges`` with open and close of the tightest block that holds the whole range and a clip, and nothing else of ``others (<by>, at)``; null where there is none."""
    found = _around(ranges, blocks(marks, by), by, "start").where("block.close >= end and block.holds_clip")
    best = found.groupBy(*by, "id").agg(F.max("block").alias("block"))
    rows = ranges.join(best, [*by, "id"], "left").withColumns({"open": F.col("block.open"), "close": F.col("block.close")}).drop("block")
    rows = rows.withColumns({"_from": F.col("open") + 1, "_to": F.col("close") + 1})
    rows = between(between(rows, others, by, "_from", "_to", "_all"), others, by, "start", "end", "_own")
    alone = F.col("_all") == F.col("_own")
    return rows.withColumns({c: F.when(alone, F.col(c)) for c in ("open", "close")}).drop("_from", "_to", "_all", "_own")


def closed(ranges: DataFrame, marks: DataFrame, by: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``ranges`` grown, as start and end, until no block has just one end inside.

    In each round a range grows to the furthest of all blocks that it cuts, whether it cuts them at its start or at its end. Blocks nest, so the first round already
    reaches the fixed point and the second sees that nothing grows; rounds are written tables, and after ``rounds`` of them ranges stay as they are then.
    """
    known = staged(blocks(marks, by), "blocks")
    rows = ranges
    for _ in range(rounds):
        left = _around(rows, known, by, "start").where("block.close >= start and block.close < end").select(*by, "id", F.col("block.open").alias("s"), F.lit(None).cast("long").alias("e"))
        right = _around(rows, known, by, "end").where("block.open >= start and block.close >= end").select(*by, "id", F.lit(None).cast("long").alias("s"), (F.col("block.close") + 1).alias("e"))
        wider = left.unionByName(right).groupBy(*by, "id").agg(F.min("s").alias("_s"), F.max("e").alias("_e"))
        grown = rows.join(wider, [*by, "id"], "left")
        rows = staged(grown.withColumns({"start": F.least("start", "_s"), "end": F.greatest("end", "_e"), "_grew": F.col("_s").isNotNull() | F.col("_e").isNotNull()}).drop("_s", "_e"), "closed-ranges")
        done = rows.where("_grew").isEmpty()
        rows = rows.drop("_grew")
        if done:
            break
    return rows


def most_overlap(ranges: DataFrame, others: DataFrame, by: list[str], cell: int = 64) -> DataFrame:
    """``ranges`` with other and overlap: which of ``others (<by>, id, start, end)`` has most in common with each, the smallest id among equals; null where none has anything.

    Both are spread over cells of ``cell`` places, and two meet only in the first cell that they share, so a pair is made once and no inequality is joined.
    """
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)))
    one = ranges.where("start < end").select(*by, "id", "start", "end", cells().alias("_cell"))
    two = others.where("start < end").select(*by, F.col("id").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))).alias("_cell"))
    shared = F.least("end", "e") - F.greatest("start", "s")
    met = one.join(two, [*by, "_cell"]).where((shared > 0) & (F.floor(F.greatest("start", "s") / cell) == F.col("_cell"))).withColumn("overlap", shared)
    best = met.groupBy(*by, "id").agg(F.max(F.struct("overlap", (-F.col("other")).alias("_other"))).alias("b"))
    best = best.select(*by, "id", (-F.col("b._other")).alias("other"), F.col("b.overlap").alias("overlap"))
    return ranges.join(best, [*by, "id"], "left")
