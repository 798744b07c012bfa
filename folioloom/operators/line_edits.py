"""Edits of lines by their place: which are applied and why others are not, and what the change does to each styled segment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _alike(a: str, b: str, most: int) -> int:
    if a[:most] == b[:most]:
        return max(0, most)
    low, high = 0, most
    # equal so far, and not further than high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _alike_batch(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None or n is None else _alike(x, y, n) for x, y, n in zip(a.to_pylist(), b.to_pylist(), most.to_pylist())], pa.int32())


def alike(a: Column, b: Column, most: Column) -> Column:
    """How many code points at the beginning of both are equal, ``most`` at most, by binary search over their lengths, in an Arrow function: what follows from it does not do it again."""
    return F.arrow_udf(_alike_batch, "int")(a, b, most.cast("int"))


def mapped(rows: DataFrame, old: str, new: str, segments: str) -> DataFrame:
    """``rows`` with parts: the text of each of a line's segments (array of structs start, end in ``old``) when the line says ``new``.

    What both have in common at the beginning and at the end stays with its segments. The rest belongs to the segment of the first difference; a
    difference behind the end belongs to the last one. A null text or an empty array has no parts.
    """
    n, m = F.length(old), F.length(new)
    rows = rows.withColumn("_p", alike(F.col(old), F.col(new), F.least(n, m)))
    rows = rows.withColumn("_s", alike(F.reverse(old), F.reverse(new), F.least(n, m) - F.col("_p")))
    rows = rows.withColumns({"_old_tail": n - F.col("_s"), "_new_tail": m - F.col("_s")})
    own = F.array_position(F.transform(segments, lambda g: (F.col("_p") >= g["start"]) & (F.col("_p") < g["end"])), F.lit(True))
    rows = rows.withColumn("_target", F.when(own > 0, own - 1).when(F.col("_p") >= n, F.size(segments) - 1).otherwise(0))

    def part(g: Column, k: Column) -> Column:
        head = F.substring(old, g["start"] + 1, F.greatest(F.least(g["end"], F.col("_p")) - g["start"], F.lit(0)))
        middle = F.when(k == F.col("_target"), F.substring(new, F.col("_p") + 1, F.col("_new_tail") - F.col("_p"))).otherwise("")
        begin, end = F.greatest(g["start"], F.col("_old_tail")), F.least(g["end"], n)
        tail = F.substring(new, F.col("_new_tail") + begin - F.col("_old_tail") + 1, F.greatest(end - begin, F.lit(0)))
        return F.concat(head, middle, tail)

    return rows.withColumn("parts", F.transform(segments, part)).drop("_p", "_s", "_old_tail", "_new_tail", "_target")


def report(lines: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """``edits (<key>, k, new_text)`` with outcome: unmatched (no such line), same (nothing changes), locked (the line cannot be written), applied, or dropped (one with a smaller k was applied to the line).

    lines: ``(<key>, text, editable)``, a row a key. Edits with a null text are the same as their line. No edit is lost, so what was not done can be told.
    """
    met = edits.join(lines.select(*key, F.col("text").alias("_text"), "editable", F.lit(True).alias("_there")), key, "left")
    outcome = F.when(F.col("_there").isNull(), "unmatched").when(F.coalesce(F.col("new_text") == F.col("_text"), F.col("new_text").isNull()), "same").when(~F.coalesce("editable", F.lit(False)), "locked").otherwise("applied")
    first = F.min(F.when(F.col("outcome") == "applied", F.col("k"))).over(W.partitionBy(*key))
    rows = met.withColumn("outcome", outcome).withColumn("_first", first)
    return rows.withColumn("outcome", F.when((F.col("outcome") == "applied") & (F.col("k") > F.col("_first")), "dropped").otherwise(F.col("outcome"))).drop("_first", "_there", "_text", "editable")


def applied(lines: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """``lines`` with the text of the edit applied to each, of ``report``'s rows, and edited (whether there is one)."""
    new = done.where("outcome = 'applied'").groupBy(*key).agg(F.min_by("new_text", "k").alias("_new"))
    rows = lines.join(new, key, "left")
    return rows.withColumn("edited", F.col("_new").isNotNull()).withColumn("text", F.coalesce("_new", "text")).drop("_new")
