"""Families of fonts found by their names, exactly or as each other's beginning, and the face that fits a wanted style best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shortest name that may be another's beginning, and words of style names.
LEAST = 4
ITALIC, BOLD, PLAIN = "italic|oblique", "bold|black|heavy|semibold|demibold", "regular|book|roman"


def family_key(name: Column) -> Column:
    """A family's name in lower case without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def style_score(style: Column, bold: Column, italic: Column) -> Column:
    """Two points for each of bold and italic that is as wanted, two off for each that is not, and one for a plain face where neither is wanted."""
    low = F.lower(style)
    fits = lambda words, want: F.when(low.rlike(words) == want, 2).otherwise(-2)
    return fits(ITALIC, italic) + fits(BOLD, bold) + F.when(low.rlike(PLAIN) & ~bold & ~italic, 1).otherwise(0)


def _beginnings(key: str, least: int) -> Column:
    n = F.length(key)
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), F.greatest(n, F.lit(least))), lambda k: F.substring(key, F.lit(1), k)))


def families(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """``(want, key)`` of each distinct wanted key: the installed family of that key, else the first (least seq) that begins with it or with which it begins; a want of under four characters has only its own.

    wanted: ``(want)``; installed: ``(key, seq)``. Both ways are equal keys: the beginnings of a want meet families, and the beginnings of families meet wants. Names are short, so each has few.
    """
    want = wanted.select("want").where("want is not null").distinct()
    known = installed.where("key is not null").groupBy("key").agg(F.min("seq").alias("seq"))
    own = want.join(known, want["want"] == known["key"]).select("want", "key", F.lit(0).alias("way"), "seq")
    long_ = want.where(F.length("want") >= LEAST)
    begins = long_.select("want", F.explode(_beginnings("want", 1)).alias("key")).join(known, "key").select("want", "key", F.lit(1).alias("way"), "seq")
    begun = known.select("key", "seq", F.explode(_beginnings("key", LEAST)).alias("want")).join(long_, "want").select("want", "key", F.lit(1).alias("way"), "seq")
    found = own.unionByName(begins).unionByName(begun)
    return found.groupBy("want").agg(F.min_by("key", F.struct("way", "seq")).alias("key"))


def faces(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """``wanted (family, bold, italic, ..)`` with face: the style of the installed face that fits best, and score; null where no family fits.

    installed: ``(family, style, seq)``; of equal scores the least seq wins. Each distinct wish is looked up once. An empty name wants nothing.
    """
    known = installed.withColumn("key", family_key(F.col("family"))).select("key", "style", "seq")
    rows = wanted.withColumn("want", family_key(F.col("family")))
    wishes = rows.select("want", "bold", "italic").distinct()
    found = wishes.join(families(wishes.where("want <> ''"), known), "want").join(known, "key")
    score = style_score(F.col("style"), F.col("bold"), F.col("italic"))
    best = found.groupBy("want", "bold", "italic").agg(F.max_by(F.struct(F.col("style").alias("face"), score.alias("score")), F.struct(score, -F.col("seq"))).alias("b"))
    on = ["want", "bold", "italic"]
    return rows.join(best.select(*on, F.col("b.face").alias("face"), F.col("b.score").cast("long").alias("score")), on, "left").drop("want")
