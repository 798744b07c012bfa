"""Places of rows in order within groups of any size: no group needs to stand in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import staged


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: the place of each among those of equal ``by``, from 1, in order of ``order``.

    Rows are dealt by range of by and order and written once, with their place in their range. What stands before a range is the sum of
    its group's earlier ranges, a row for each range and group. Null keys are a group; equal orders are parted by where they stand.
    """
    sorted_ = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = staged(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranked")
    parts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    keys = {c: f"_key{k}" for k, c in enumerate([*by, "_part"])}
    parts = parts.select(*(F.col(c).alias(k) for c, k in keys.items()), "_first", "_before")
    met = F.lit(True)
    for c, k in keys.items():
        met = met & F.col(c).eqNullSafe(F.col(k))
    found = placed.join(parts, met)
    return found.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long").alias(name))
