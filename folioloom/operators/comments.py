"""Comment threads: replies, depth, order and authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.sources.tables import staged

def filtered(comments: DataFrame, author: str | None = None, text: str | None = None) -> DataFrame:
    out = comments if author is None else comments.where(F.col("author") == author)
    return out if text is None else out.where(F.lower("text").contains(text.lower()))


def authors(comments: DataFrame) -> DataFrame:
    return comments.where("author is not null and author <> ''").select("author").distinct()


def threads(comments: DataFrame, thread: str, id_: str, parent: str) -> DataFrame:
    """``comments`` with root and depth (0 for a root); a comment whose parent is missing in its thread is a root.

    Parents are doubled: after k rounds each comment knows its ancestor 2 ** k up, so n replies in a row take log2(n) joins,
    each from a staged table. Replies that go round in a circle have a null root and depth.
    """
    ids = comments.select(thread, F.col(id_).alias("_p")).distinct()
    own = comments.withColumn("_p", F.col(parent)).join(ids.withColumn("_there", F.lit(True)), [thread, "_p"], "left")
    up = own.select(thread, F.col(id_).alias("_id"), F.when(F.col("_there"), F.col("_p")).alias("_up")).distinct()
    up = up.withColumn("_open", F.col("_up").isNotNull()).withColumn("_d", F.col("_open").cast("long")).withColumn("_up", F.coalesce("_up", "_id"))
    up = staged(up, "replies")
    for _ in range(up.count().bit_length() + 1):
        above = up.select(thread, F.col("_id").alias("_up"), F.col("_up").alias("_up2"), F.col("_d").alias("_d2"))
        up = up.join(above, [thread, "_up"]).select(thread, "_id", F.col("_up2").alias("_up"), (F.col("_d2") > 0).alias("_open"), (F.col("_d") + F.col("_d2")).alias("_d"))
        up = staged(up, "replies")
        if up.where("_open").isEmpty():
            break
    ended = lambda c: F.when(~F.col("_open"), F.col(c))
    return comments.join(up.select(thread, F.col("_id").alias(id_), ended("_up").alias("root"), ended("_d").alias("depth")), [thread, id_])


def in_display_order(threaded: DataFrame, thread: str, id_: str, written: str) -> DataFrame:
    """Rows of ``threads`` with place (from 1 in a root's thread): the root, then all that hangs from it, however deep, as it was written; null where there is no root."""
    order = W.partitionBy(thread, "root").orderBy(F.col("depth") > 0, F.when(F.col("depth") > 0, F.col(written)), "depth", id_)
    return threaded.withColumn("place", F.when(F.col("root").isNotNull(), F.row_number().over(order)).cast("long"))
