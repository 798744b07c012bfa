"""Finding and replacing text in lines, and what a box of characters covers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(query: str, regard_case: bool = False) -> str:
    """A regular expression that matches ``query`` as it stands."""
    return ("" if regard_case else "(?iu)") + re.sub(r"([^\w\s]|_)", r"\\\1", query)


def places(text: Column, query: str) -> Column:
    """Starts (code points of ``text`` as it stands, from 0) of ``query`` without regard to case, none inside another."""
    parts = F.split(text, pattern(query))
    lengths = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda a, n: F.struct((a["at"] + n + len(query)).alias("at"), F.concat(a["found"], F.array(a["at"] + n)).alias("found"))
    return F.aggregate(lengths, start, step)["found"]


def search(lines: DataFrame, query: str) -> DataFrame:
    """``lines`` with start and end of each hit, a row a hit."""
    hit = lines.where(F.col("text").rlike(pattern(query)))
    return hit.withColumn("start", F.explode(places(F.col("text"), query))).withColumn("end", F.col("start") + len(query))


def replaced(text: Column, query: str, new: str, only: Column | None = None, sweeps: int = 4, regard_case: bool = False) -> Column:
    """``text`` with every hit of ``query`` replaced, found as ``search`` finds them; only: the number of the one hit (from 0) to replace.

    What a sweep joins may be a hit anew, so ``sweeps`` of them are made, each over what the one before left; one is made if ``new`` holds ``query``, whose hits would never end.
    """
    wanted, put = pattern(query, regard_case), new.replace("\\", "\\\\").replace("$", "\\$")
    if only is not None:
        at = F.get(places(text, query), only)
        return F.when(at.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), at), F.lit(new), F.substring(text, at + len(query) + 1, F.length(text))))
    again = 1 if re.search(re.escape(query), new, 0 if regard_case else re.IGNORECASE) else sweeps
    for _ in range(again):
        text = F.regexp_replace(text, wanted, put)
    return text


def step_hit(current: Column, by: int, n: Column) -> Column:
    """The hit after or before ``current``, round the ends."""
    return F.pmod(current + by, n)
