"""Page plans: ranges, chunks, order, rotation, cropping and numbers across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import ranked


def page_range(text: Column, pages: Column) -> Column:
    """Pages named by ``1-3, 5, 8-``: sorted, each once, from 1 to ``pages``. A lone ``-`` is all; pieces that say nothing are skipped."""
    piece = F.transform(F.split(text, ","), lambda p: F.trim(p))
    wanted = F.filter(piece, lambda p: p.rlike(r"^\d*\s*-\s*\d*$|^\d+$"))

    def bounds(p: Column) -> Column:
        first = F.regexp_extract(p, r"^(\d*)", 1)
        last = F.when(p.contains("-"), F.regexp_extract(p, r"-\s*(\d*)$", 1)).otherwise(first)
        low = F.greatest(F.coalesce(F.nullif(first, F.lit("")).cast("int"), F.lit(1)), F.lit(1))
        high = F.least(F.coalesce(F.nullif(last, F.lit("")).cast("int"), pages), pages)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(wanted, bounds))))


def split_chunks(pages: DataFrame, file: str, page: str, per_file: int) -> DataFrame:
    """``pages`` with run and chunk: gaps in the page numbers cut first, then every ``per_file`` pages; both count from 0 in a file."""
    size = max(1, int(per_file))
    order = W.partitionBy(file).orderBy(page)
    jump = (F.col(page) - F.lag(page, 1).over(order) != 1).cast("int")
    rows = pages.withColumn("run", F.sum(F.coalesce(jump, F.lit(0))).over(order))
    inside = F.row_number().over(W.partitionBy(file, "run").orderBy(page)) - 1
    rows = rows.withColumn("_in", F.floor(inside / size).cast("int"))
    starts = (F.col("_in") != F.lag("_in", 1).over(order)) | (F.col("run") != F.lag("run", 1).over(order))
    return rows.withColumn("chunk", F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(order).cast("int")).withColumn("run", F.col("run").cast("int")).drop("_in")


def running_numbers(pages: DataFrame, file: str, page: str, start: int = 1) -> DataFrame:
    """``pages`` with number: they run on from file to file in order of ``file``, then ``page``.

    Pages are counted a file, files a bucket of about the root of their number, and only buckets' sums are added up in one
    task; so no task holds all files. One file's pages stand in one task; ``ranks.ranked`` is for files of any length.
    """
    per_file = pages.groupBy(file).agg(F.count("*").alias("_n"))
    edge = per_file.agg(F.count("*").alias("n"), F.min(file).alias("low"), F.max(file).alias("high")).first()
    parts = max(1, int((edge["n"] or 0) ** 0.5))
    width = max(1.0, ((edge["high"] or 0) - (edge["low"] or 0) + 1) / parts)
    per_file = per_file.withColumn("_b", F.floor((F.col(file) - F.lit(edge["low"] or 0)) / F.lit(width)))
    before = W.partitionBy("_b").orderBy(file).rowsBetween(W.unboundedPreceding, -1)
    buckets = per_file.groupBy("_b").agg(F.sum("_n").alias("_s"))
    bases = buckets.select("_b", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    starts = per_file.withColumn("_own", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(bases, "_b").select(file, (F.col("_base") + F.col("_own")).alias("_before"))
    rank = F.row_number().over(W.partitionBy(file).orderBy(page))
    return pages.withColumn("_r", rank).join(starts, file).withColumn("number", (F.lit(start - 1) + F.col("_before") + F.col("_r")).cast("long")).drop("_r", "_before")


def rotated(rotation: Column, by: Column) -> Column:
    return F.pmod(rotation + by, F.lit(360))


def cropped(box: dict[str, Column], media: dict[str, Column]) -> Column:
    """A crop box inside the media box (x0, y0, x1, y1)."""
    inside = lambda v, low, high: F.least(F.greatest(v, low), high)
    return F.struct(*(inside(box[k], media[k[0] + "0"], media[k[0] + "1"]).alias(k) for k in ("x0", "y0", "x1", "y1")))


def merged(first: DataFrame, second: DataFrame, order: str) -> DataFrame:
    """``first`` then ``second`` with pos: the place in the whole, counted from 0. Ranges of pages are counted, not whole files."""
    both = first.withColumn("_file", F.lit(0)).unionByName(second.withColumn("_file", F.lit(1)))
    return ranked(both, [], ["_file", order], "pos").withColumn("pos", F.col("pos") - 1).drop("_file")


def reordered(pages: DataFrame, file: str, page: str, order: Column) -> DataFrame:
    """``pages`` with pos (from 0 in a file) after a move: ``order`` is the place each page asks for, ties by page."""
    return pages.withColumn("pos", F.row_number().over(W.partitionBy(file).orderBy(order, page)) - 1)


def with_blanks(pages: DataFrame, file: str, page: str, after: Column) -> DataFrame:
    """``(file, page, pos)``: a blank page, whose page is null, behind each one where ``after`` holds; pos counts from 0."""
    parts = F.when(after, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = pages.select(file, page, F.explode(parts).alias("_blank"))
    pos = F.row_number().over(W.partitionBy(file).orderBy(page, "_blank")) - 1
    return rows.select(file, F.when(F.col("_blank") == 0, F.col(page)).alias(page), pos.alias("pos"))


def chunk_names(chunks: DataFrame, file: str, chunk: str, stem: Column) -> DataFrame:
    """``chunks`` with name: the stem, and the chunk's number from 1 with as many digits as the file's last one has."""
    most = F.max(chunk).over(W.partitionBy(file)) + 1
    number = (F.col(chunk) + 1).cast("string")
    return chunks.withColumn("name", F.concat(stem, F.lit("-"), F.lpad(number, F.length(most.cast("string")), F.lit("0")), F.lit(".pdf")))
