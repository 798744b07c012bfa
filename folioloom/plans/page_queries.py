"""Page plans over orders as files and lineitem as their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import pages
from folioloom.sources.tables import table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")


def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of each order, with a number left out after every third one, so runs have gaps; two pages a chunk."""
    number = F.col("l_linenumber") + F.floor((F.col("l_linenumber") - 1) / 3).cast("int")
    kept = _pages(spark, sf_dir).select("l_orderkey", number.alias("l_linenumber")).distinct()
    return pages.split_chunks(kept, "l_orderkey", "l_linenumber", 2)


def parse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range text made of each order's key over its pages."""
    per = _pages(spark, sf_dir).groupBy("l_orderkey").agg(F.max("l_linenumber").cast("int").alias("n"))
    k = F.col("l_orderkey")
    spec = F.when(k % 4 == 0, F.lit("-")).when(k % 4 == 1, F.concat((k % 3 + 1).cast("string"), F.lit("-"))).when(k % 4 == 2, F.lit("3, 1-2, x, 2")).otherwise(F.concat(F.lit("-"), (k % 5).cast("string"), F.lit(", 6-")))
    return per.withColumn("spec", spec).withColumn("page", F.explode_outer(pages.page_range(F.col("spec"), F.col("n")))).select("l_orderkey", "spec", "page")


def bates_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.running_numbers(_pages(spark, sf_dir).select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


def stamp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = bates_numbers(spark, sf_dir)
    total = numbered.groupBy("l_orderkey").agg(F.count("*").alias("pages"))
    rows = numbered.join(total, "l_orderkey")
    stamp = text.stamp_text("Page {page} of {pages} - {n}", F.col("l_linenumber"), F.col("pages"), F.col("number"), 6)
    return rows.select("l_orderkey", "l_linenumber", stamp.alias("stamp"))


def merge_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders, then all others, as one file."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    done, open_ = (orders.where(F.col("o_orderstatus").eqNullSafe("F") == s).select("o_orderkey") for s in (True, False))
    return pages.merged(done, open_, "o_orderkey")


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and third page of each order, third first."""
    plan = spark.createDataFrame([(3, 0), (1, 1)], "l_linenumber int, pos int")
    return _pages(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey").join(F.broadcast(plan), "l_linenumber").select("l_orderkey", "pos", "l_partkey")


def rotate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns add up page by page in the order they were asked for."""
    rows = _pages(spark, sf_dir).withColumn("turn", F.when(F.col("l_partkey") % 2 == 0, 90).otherwise(-90))
    total = F.sum("turn").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", pages.rotated(total, F.lit(0)).cast("int").alias("rotation"))


def crop_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = {k: F.lit(v) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 612.0), ("y1", 792.0))}
    q = F.col("l_quantity")
    box = {"x0": 10 * q - 100, "y0": 5 * q - 50, "x1": 30 * q, "y1": 40 * q}
    return _pages(spark, sf_dir).withColumn("b", pages.cropped(box, media)).select("l_orderkey", "l_linenumber", "b.x0", "b.y0", "b.x1", "b.y1")


QUERIES = {f.__name__: f for f in (split_chunks, parse_range, bates_numbers, stamp_text, merge_append, extract_pages, rotate_plan, crop_clamp)}

_NUMBERED = "n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS number, count(*) OVER (PARTITION BY l_orderkey) AS pages FROM lineitem)"
SQL = {
    "split_chunks": """WITH p AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber + (l_linenumber - 1) // 3 AS INT) AS l_linenumber FROM lineitem),
r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM p),
c AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY island) - 1 AS run, (row_number() OVER (PARTITION BY l_orderkey, island ORDER BY l_linenumber) - 1) // 2 AS part FROM r)
SELECT l_orderkey, l_linenumber, CAST(run AS INT) AS run, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY run, part) - 1 AS INT) AS chunk FROM c""",
    "parse_range": """WITH n AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey),
s AS (SELECT *, CASE l_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN (l_orderkey % 3 + 1) || '-' WHEN 2 THEN '3, 1-2, x, 2' ELSE '-' || (l_orderkey % 5) || ', 6-' END AS spec FROM n),
p AS (SELECT l_orderkey, p FROM s, range(1, 8) r(p) WHERE p <= n AND CASE l_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN p >= l_orderkey % 3 + 1 WHEN 2 THEN p <= 3 ELSE p <= l_orderkey % 5 OR p >= 6 END)
SELECT s.l_orderkey, spec, CAST(p AS INT) AS page FROM s LEFT JOIN p USING (l_orderkey)""",
    "bates_numbers": f"WITH {_NUMBERED} SELECT l_orderkey, l_linenumber, number FROM n",
    "stamp_text": f"WITH {_NUMBERED} SELECT l_orderkey, l_linenumber, 'Page ' || l_linenumber || ' of ' || pages || ' - ' || lpad(CAST(number AS VARCHAR), CAST(greatest(6, length(CAST(number AS VARCHAR))) AS INT), '0') AS stamp FROM n",
    "merge_append": "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END, o_orderkey) - 1 AS pos FROM orders",
    "extract_pages": "SELECT l_orderkey, CAST(CASE l_linenumber WHEN 3 THEN 0 ELSE 1 END AS INT) AS pos, l_partkey FROM lineitem WHERE l_linenumber IN (1, 3)",
    "rotate_plan": """SELECT l_orderkey, l_linenumber, CAST(((t % 360) + 360) % 360 AS INT) AS rotation
FROM (SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_partkey % 2 = 0 THEN 90 ELSE -90 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS t FROM lineitem)""",
    "crop_clamp": """SELECT l_orderkey, l_linenumber, least(greatest(10 * l_quantity - 100, 0), 612.0::DOUBLE) AS x0, least(greatest(5 * l_quantity - 50, 0), 792.0::DOUBLE) AS y0,
least(greatest(30 * l_quantity, 0), 612.0::DOUBLE) AS x1, least(greatest(40 * l_quantity, 0), 792.0::DOUBLE) AS y1 FROM lineitem""",
}
