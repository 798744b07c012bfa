"""Text of documents as placed runs: a run a word, eight words a row, with the odd things that drawn pages have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Text lines of a page, words of a row, and width of a character in points.
PAGE_LINES, ROW_WORDS, CHAR = 40, 8, 6.0
#: Shuffle partitions for each split of the table that is read. A run takes twenty times the room of its word, so sizes of shuffled text would say too few.
PARTS = 16


def parts_of(documents: DataFrame) -> int:
    """Shuffle partitions for the runs of a table: in proportion to its splits."""
    return PARTS * max(1, documents.rdd.getNumPartitions())


def runs_of(documents: DataFrame) -> DataFrame:
    """Runs ``(doc_id, page, seq, stream, text, font, size, fill, mode, dir_x, dir_y, u, v, advance, ascent, descent, confident)`` of whole texts.

    By arithmetic on places: some words touch, some stand a column away, some are hidden, some have a space of their own; font, size and
    fill change; every thirteenth text line is drawn twice, every 29th upright. Null and blank texts have no runs.
    The windows sort each task by page, line and word, so a page's runs leave together and in order of seq.
    """
    line = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "line")).withColumn("page", F.floor(F.col("l") / PAGE_LINES))
    # dealt by page while a page is text alone: windows and groups over pages, lines and segments need no shuffle of runs behind this
    line = line.repartition(parts_of(documents), "doc_id", "page")
    word = line.select("doc_id", "page", "l", F.posexplode(F.array_remove(F.split("line", r"[\x20\x09-\x0D]+"), "")).alias("w", "word"))
    word = word.withColumns({"row": F.floor(F.col("w") / ROW_WORDS), "k": F.col("doc_id") + 7 * F.col("l") + F.col("w")})
    twice = word.withColumn("pass", F.explode(F.when(F.col("l") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    size = F.when(F.col("l") % 5 == 0, 12.0).otherwise(10.0)
    kind = F.col("k") % 11
    gap = F.when(kind == 0, 0.0).when(kind == 1, 30.0).otherwise(4.0)
    advance = F.length("word") * CHAR
    so_far = W.partitionBy("doc_id", "page", "l", "pass", "row").orderBy("w").rowsBetween(W.unboundedPreceding, -1)
    # a row's words are in order with its line's, so both windows share one sort
    order = W.partitionBy("doc_id", "page").orderBy("l", "pass", "row", "w")
    upright = F.col("l") % 29 == 3
    return twice.select(
        "doc_id",
        "page",
        F.row_number().over(order).cast("long").alias("seq"),
        F.lit("page").alias("stream"),
        F.concat("word", F.when(F.col("k") % 6 == 0, " ").otherwise("")).alias("text"),
        F.when(F.floor(F.col("k") / 5) % 7 == 0, "B").otherwise("A").alias("font"),
        size.alias("size"),
        F.when(F.floor(F.col("w") / 9) % 3 == 1, 1).otherwise(0).alias("fill"),
        F.when(F.col("k") % 37 == 0, 3).otherwise(0).alias("mode"),
        F.when(upright, 0.0).otherwise(1.0).alias("dir_x"),
        F.when(upright, 1.0).otherwise(0.0).alias("dir_y"),
        (F.coalesce(F.sum(advance + gap).over(so_far), F.lit(0.0)) + F.col("pass") * 0.25).alias("u"),
        (-14.0 * (F.col("l") * 4 + F.col("row")) + (F.col("w") * 7 % 5) * 0.25).alias("v"),
        advance.alias("advance"),
        F.lit(750.0).alias("ascent"),
        F.lit(-250.0).alias("descent"),
        (F.col("k") % 41 != 0).alias("confident"),
    )
