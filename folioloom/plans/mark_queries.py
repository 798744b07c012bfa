"""Line items as marks on pages: written as content, moved, and replayed to see where they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marks, replay
from ..sources.placed import parts_of
from ..sources.tables import table

KINDS = ("line", "arrow", "rect", "ellipse", "cloud", "dot", "fill")
SHEET, ORDER = ["sheet"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sheet, content)``: the line items of twenty orders, in order, each a mark behind a matrix, moved by (5.5, -2.25) of the page, with a stroke after it that must not move."""
    items = table(spark, sf_dir, "lineitem")
    # dealt by sheet while a mark is a line item alone: its content is a hundred times longer
    rows = items.withColumn("sheet", F.floor(F.col("l_orderkey") / 20)).repartition(parts_of(items), "sheet").sortWithinPartitions("sheet", *ORDER)
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 7).cast("int"))
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 10).cast("double")
    width = (F.col("l_linenumber") / 2).cast("double")
    rows = rows.withColumns({"mark": kind, "a": marks.point(x, y), "b": marks.point(x + F.col("l_quantity"), y + F.col("l_linenumber") * 6)})
    kind, a, b = F.col("mark"), F.col("a"), F.col("b")
    rows = rows.withColumn("corners", marks.shape_points(F.lit("rect"), a, b, width))
    colour = (F.lit(0.25), F.col("l_linenumber") / 8, F.lit(1.0))
    points = F.when(kind == "cloud", marks.cloud_points(F.col("corners"), F.lit(8))).when(kind == "dot", F.array(a)).otherwise(marks.shape_points(kind, a, b, width))
    rows = rows.withColumn("points", points)
    own = F.when(kind == "fill", marks.filled((x, y, F.col("l_quantity").cast("double"), F.lit(3.5)), colour)).otherwise(marks.stroke(F.col("points"), width, colour, marks.is_closed(kind)))
    rows = rows.withColumn("own", own)
    scaled = F.col("l_returnflag") == "R"
    ctm = F.when(scaled, F.array(*map(F.lit, (2.0, 0.0, 0.0, 0.5, 3.0, 4.0)))).otherwise(F.array(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 100.0, 0.0))))
    after = F.lit("0 0 m 1 1 l S Q\n")
    content = F.concat(F.when(scaled, "q 2 0 0 .5 3 4 cm ").otherwise("q 0 1 -1 0 100 0 cm "), marks.moved(F.col("own"), ctm, F.lit(5.5), F.lit(-2.25)), after)
    return rows.select("sheet", content.alias("content"))


def mark_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every line item's mark, and the stroke behind it, lie on the page."""
    rows = replay.pieces_replayed(_marks(spark, sf_dir), SHEET, ["path"], ["seq", "op", "width", "stroke", "fill", "x0", "y0", "x1", "y1"])
    boxes = [F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return rows.select(*SHEET, "seq", "op", "width", F.get("stroke", 1).alias("stroke_green"), F.get("fill", 1).alias("fill_green"), *boxes)


QUERIES = {f.__name__: f for f in (mark_boxes,)}
#: Boxes from the corners; places are cut to three decimals as content writes them.
SQL = {
    "mark_boxes": """WITH m AS (SELECT *, l_orderkey // 20 AS sheet, row_number() OVER (PARTITION BY l_orderkey // 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, ['line', 'arrow', 'rect', 'ellipse', 'cloud', 'dot', 'fill'][l_partkey % 7 + 1] AS mark, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 10 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w, l_linenumber * 6.0::DOUBLE AS h, l_linenumber / 2.0::DOUBLE AS wide, l_returnflag = 'R' AS r FROM lineitem),
n AS (SELECT *, atan2(h, w) AS ang, greatest(6, wide * 3.5) AS head, w / greatest(1, floor(w / 8 + 0.5)) / 2 AS rw, h / greatest(1, floor(h / 8 + 0.5)) / 2 AS rh FROM m),
p AS (SELECT *, CASE mark WHEN 'arrow' THEN least(x, x + w - cos(ang + pi() / 7) * head, x + w - cos(ang - pi() / 7) * head) WHEN 'cloud' THEN x - rh ELSE x END AS a0,
  CASE mark WHEN 'arrow' THEN least(y, y + h - sin(ang + pi() / 7) * head, y + h - sin(ang - pi() / 7) * head) WHEN 'cloud' THEN y - rw ELSE y END AS b0,
  CASE mark WHEN 'arrow' THEN greatest(x + w, x + w - cos(ang + pi() / 7) * head, x + w - cos(ang - pi() / 7) * head) WHEN 'cloud' THEN x + w + rh WHEN 'dot' THEN x ELSE x + w END AS a1,
  CASE mark WHEN 'arrow' THEN greatest(y + h, y + h - sin(ang + pi() / 7) * head, y + h - sin(ang - pi() / 7) * head) WHEN 'cloud' THEN y + h + rw WHEN 'dot' THEN y WHEN 'fill' THEN y + 3.5 ELSE y + h END AS b1 FROM n),
q AS (SELECT *, floor(a0 * 1000 + 0.5) / 1000 AS c0, floor(b0 * 1000 + 0.5) / 1000 AS d0, floor(a1 * 1000 + 0.5) / 1000 AS c1, floor(b1 * 1000 + 0.5) / 1000 AS d1 FROM p),
u AS (SELECT sheet, 2 * k - 2 AS seq, CASE WHEN mark = 'fill' THEN 'f' ELSE 'S' END AS op, CASE WHEN mark = 'fill' THEN 1.0::DOUBLE ELSE wide END AS width, CASE WHEN mark = 'fill' THEN 0 ELSE l_linenumber / 8.0::DOUBLE END AS sg, CASE WHEN mark = 'fill' THEN l_linenumber / 8.0::DOUBLE ELSE 0 END AS fg,
  CASE WHEN r THEN 2 * c0 + 8.5 ELSE 105.5 - d1 END AS x0, CASE WHEN r THEN d0 / 2 + 1.75 ELSE c0 - 2.25 END AS y0, CASE WHEN r THEN 2 * c1 + 8.5 ELSE 105.5 - d0 END AS x1, CASE WHEN r THEN d1 / 2 + 1.75 ELSE c1 - 2.25 END AS y1 FROM q
  UNION ALL SELECT sheet, 2 * k - 1, 'S', 1, 0, 0, CASE WHEN r THEN 3 ELSE 99 END, CASE WHEN r THEN 4 ELSE 0 END, CASE WHEN r THEN 5 ELSE 100 END, CASE WHEN r THEN 4.5 ELSE 1 END FROM q)
SELECT sheet, CAST(seq AS BIGINT) AS seq, op, CAST(width AS DOUBLE) AS width, floor(sg * 1000 + 0.5) / 1000 AS stroke_green, floor(fg * 1000 + 0.5) / 1000 AS fill_green, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM u""",
}
