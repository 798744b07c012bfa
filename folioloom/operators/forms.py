"""Form fields, recognised words and stored pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked


def filled(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Fields ``(file, field, value, read_only, max_length)`` with the new ``(file, field, new)``: value and outcome.

    Outcomes: filled, cleared (an empty value), read only (kept), kept (nothing new); a value for no field has outcome missing.
    """
    rows = fields.join(values, ["file", "field"], "full")
    there = F.col("read_only").isNotNull()
    cut = F.when(F.col("max_length").isNotNull(), F.substring("new", F.lit(1), F.col("max_length"))).otherwise(F.col("new"))
    outcome = F.when(~there, "missing").when(F.col("new").isNull(), "kept").when(F.col("read_only"), "read only").when(F.col("new") == "", "cleared").otherwise("filled")
    return rows.withColumn("outcome", outcome).withColumn("value", F.when(F.col("outcome").isin("filled", "cleared"), cut).otherwise(F.col("value"))).select("file", "field", "value", "outcome")


def unique_names(names: DataFrame, scope: str, order: str, name: str = "name") -> DataFrame:
    """``names`` with unique: of equal names of a scope the first stays and others get " 2", " 3" and so on. A name may stand in any number of rows."""
    placed = ranked(names, [scope, name], [order], "_place")
    return placed.withColumn("unique", F.when(F.col("_place") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" "), F.col("_place").cast("string")))).drop("_place")


def recognised(words: DataFrame, least: int = 40) -> DataFrame:
    """Words sure enough to be set, with size (95 % of the box's height, 4 to 72) and scale (20 to 400 per cent of their width)."""
    size = F.least(F.greatest(0.95 * F.col("height"), F.lit(4.0)), F.lit(72.0))
    natural = F.length("text") * 0.5 * size
    return words.where(F.col("confidence") >= least).withColumn("size", size).withColumn("scale", F.least(F.greatest(100 * F.col("width") / natural, F.lit(20.0)), F.lit(400.0)))


def page_confidence(words: DataFrame, *keys: str) -> DataFrame:
    return words.groupBy(*keys).agg(F.avg("confidence").alias("confidence"))


def target_pixels(width: Column, height: Column, drawn_points: Column, dpi: int = 150, headroom: float = 1.1) -> Column:
    """Pixels (width, height) that a picture drawn so many points wide needs; null where it has hardly more."""
    want = F.greatest(F.floor(drawn_points / 72 * dpi + 0.5), F.lit(1))
    return F.when(width > want * headroom, F.struct(want.cast("long").alias("width"), F.greatest(F.floor(height * want / width + 0.5), F.lit(1)).cast("long").alias("height")))
