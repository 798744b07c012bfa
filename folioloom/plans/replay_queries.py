"""Pages written as content streams, from lines of documents, and replayed: placed runs, boxes and the marks round them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, replay
from ..sources.placed import parts_of
from ..sources.tables import table

PAGE, PAGE_LINES = ["doc_id", "page"], 40


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, page, streams, objects)``: a stream for each 40 lines, each line shown in one of six ways, a form that each page draws, and a picture."""
    documents = table(spark, sf_dir, "documents")
    lines = compare.doc_lines(documents).where("text is not null")
    escaped = lambda c: F.concat(F.lit("("), F.regexp_replace(c, r"([\\()])", r"\\$1"), F.lit(")"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    left, right = F.substring("text", F.lit(1), half), F.substring("text", half + 1, n)
    ways = (
        F.concat(escaped(F.col("text")), F.lit(" Tj T*")),
        F.concat(F.lit("["), escaped(left), F.lit("-300"), escaped(right), F.lit("] TJ T*")),
        F.concat(F.lit("q /B 10 Tf 2 Tc <"), F.hex(F.encode("text", "UTF-16BE")), F.lit("> Tj Q 0 -14 Td")),
        F.concat(F.lit("<"), F.hex("text"), F.lit("> '")),
        F.concat(F.lit("1 0.5 "), escaped(F.col("text")), F.lit(' "')),
        F.concat(F.lit("1 0 0 rg 3 Tr "), escaped(F.col("text")), F.lit(" Tj 0 Tr 0 g T*")),
    )
    kind, shown = (F.col("doc_id") + F.col("line_no")) % 6, ways[0]
    for k, way in enumerate(ways[1:], 1):
        shown = F.when(kind == k, way).otherwise(shown)
    rows = lines.select("doc_id", F.floor(F.col("line_no") / PAGE_LINES).alias("page"), "line_no", shown.alias("shown"))
    rows = rows.repartition(parts_of(documents), *PAGE).groupBy(*PAGE).agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "shown")))["shown"], "\n").alias("body"), F.count("*").alias("n"))
    head = F.concat(F.lit("q .5 0 0 .5 10 20 cm BT /A 12 Tf 14 TL "), F.when(F.col("doc_id") % 3 == 0, "80 Tz ").otherwise(""), F.lit("1 0 0 1 72 700 Tm\n"))
    tail = F.concat(F.lit("\nET Q q 0 0 300 400 re W n 2 0 0 2 5 5 cm /Fm Do Q 0.25 0.5 0 0.5 k 10 "), F.col("n").cast("string"), F.lit(" 20 30 re f q 40 0 0 50 7 8 cm /Im Do Q"))
    form = F.lit("BT /A 10 Tf 5 7 Td (form) Tj ET 1 w 0 0 m 30 20 l 10 -4 5 6 7 8 c S")
    streams = F.array(*(F.struct(F.lit(n).alias("stream"), F.encode(c, "UTF-8").alias("content")) for n, c in (("page", F.concat(head, "body", tail)), ("form", form))))
    drawn = F.struct(F.lit("page").alias("stream"), F.lit("Fm").alias("name"), F.lit("form").alias("kind"), F.lit("form").alias("target"), F.array(*(F.lit(float(x)) for x in (1, 0, 0, 1, 1, 2))).alias("matrix"))
    image = F.struct(F.lit("page").alias("stream"), F.lit("Im").alias("name"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("array<double>").alias("matrix"))
    return rows.select(*PAGE, streams.alias("streams"), F.array(drawn, image).alias("objects"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    salts = replay.SALTS * table(spark, sf_dir, "documents").rdd.getNumPartitions()
    return replay.runs(replay.pages_replayed(_pages(spark, sf_dir), PAGE, ["text"]), *_fonts(spark, sf_dir), PAGE, salts)


def _characters(texts: pa.Array) -> pa.Array:
    """Each text's characters, once."""
    return pa.array([None if t is None else sorted(set(t)) for t in texts.to_pylist()], pa.list_(pa.string()))


def _fonts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A font of one byte that knows ASCII, and one of two bytes that knows every character of all documents but those beyond two bytes."""
    fonts = spark.createDataFrame([("A", False, 250.0, 750.0, -250.0, True), ("B", True, 300.0, 800.0, -200.0, False)], "font string, two_byte boolean, missing_width double, ascent double, descent double, confident boolean")
    one = spark.range(32, 127).select(F.lit("A").alias("font"), F.col("id").alias("code"), F.char("id").alias("glyph"), (500.0 + F.col("id") % 5 * 40).alias("width"))
    glyph = table(spark, sf_dir, "documents").select(F.explode(F.arrow_udf(_characters, "array<string>")("text")).alias("glyph")).distinct()
    two = glyph.where("length(encode(glyph, 'UTF-16BE')) = 2").withColumn("code", F.conv(F.hex(F.encode("glyph", "UTF-16BE")), 16, 10).cast("long"))
    return fonts, one.unionByName(two.select(F.lit("B").alias("font"), "code", "glyph", (1000.0 - F.col("code") % 3 * 100).alias("width")))


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that every page shows, with its place, size, colour and width."""
    found = _runs(spark, sf_dir)
    places = [F.round(c, 4).alias(c) for c in ("size", "x", "y", "u", "v", "advance")]
    return found.select(*PAGE, "seq", "stream", "op", "text", "font", "mode", F.array_join(F.transform("fill", lambda c: c.cast("string")), " ").alias("fill"), *places)


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path and picture of every page, with its box, colour, clip and depth."""
    fields = ["seq", "stream", "kind", "op", "depth", "fill", "clip", "clip_complex", "x0", "y0", "x1", "y1"]
    found = replay.pages_replayed(_pages(spark, sf_dir), PAGE, ["path", "image"], fields)
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return found.select(*PAGE, "seq", "stream", "kind", "op", "depth", shown("fill"), shown("clip"), "clip_complex", "x0", "y0", "x1", "y1")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page, grouped from the runs that its stream shows, with how many runs they hold."""
    from ..operators import layout

    found = _runs(spark, sf_dir)
    lines = layout.lines(layout.grouped_runs(found, PAGE), PAGE)
    return lines.select(*PAGE, "line", "seq", "stream", "text", "font", "editable", "n_runs")


QUERIES = {f.__name__: f for f in (page_runs, page_boxes, page_lines)}

#: The same places from the lines themselves, without streams: a line moves the next down, those of ways 3 and 4 move before they show.
_SHOWN = r"""ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS l FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, l // 40 AS page, (doc_id + l) % 6 AS way, CASE WHEN doc_id % 3 = 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS th,
  CASE WHEN max(CASE WHEN (doc_id + l) % 6 = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, l // 40 ORDER BY l) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quoted FROM ls),
w AS (SELECT *, string_split(text, '') AS cs, regexp_replace(text, '[^ -~]', '', 'g') AS plain FROM k),
a AS (SELECT *, CASE WHEN way = 2 THEN
    list_sum(list_transform(cs, lambda c: CASE WHEN c = '' THEN 0 WHEN ord(c) > 65535 THEN 10.0 * (300 + 300) / 1000 + 4 ELSE 10.0 * (1000 - ord(c) % 3 * 100) / 1000 + 2 END)) * th
  ELSE th * (12.0 / 1000 * (coalesce(list_sum(list_transform(string_split(plain, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 500 + ord(c) % 5 * 40 END)), 0) + 250 * (strlen(text) - length(plain)))
    + quoted * (0.5 * strlen(text) + length(plain) - length(replace(plain, ' ', '')))) + CASE WHEN way = 1 THEN 3.6 * th ELSE 0 END END AS adv,
  CASE WHEN way = 2 THEN list_aggregate(list_filter(cs, lambda c: c <> '' AND ord(c) <= 65535), 'string_agg', '') WHEN way <> 1 THEN plain
    ELSE concat(regexp_replace(left(text, length(text) // 2), '[^ -~]', '', 'g'), CASE WHEN regexp_matches(left(text, length(text) // 2), '[!-~][^ -~]*$') THEN ' ' ELSE '' END, regexp_replace(substr(text, length(text) // 2 + 1), '[^ -~]', '', 'g')) END AS shown FROM w),
s AS (SELECT *, l - page * 40 AS i, CASE WHEN way NOT IN (3, 4) AND lag(way) OVER o IN (3, 4) THEN lag(adv) OVER o ELSE 0 END AS shift, count(*) OVER (PARTITION BY doc_id, page) AS n FROM a WINDOW o AS (PARTITION BY doc_id, page ORDER BY l)),
p AS (SELECT doc_id, page, i AS seq, 'page' AS stream, CASE way WHEN 1 THEN 'TJ' WHEN 3 THEN '''' WHEN 4 THEN '"' ELSE 'Tj' END AS op, coalesce(shown, '') AS text, CASE WHEN way = 2 THEN 'B' ELSE 'A' END AS font, CASE WHEN way = 5 THEN 3 ELSE 0 END AS mode,
  CASE WHEN way = 5 THEN '1.0 0.0 0.0' ELSE '0.0 0.0 0.0' END AS fill, CASE WHEN way = 2 THEN 5.0 ELSE 6.0 END AS size, (72 + shift) / 2 + 10 AS x, (700 - 14 * (i + CASE WHEN way IN (3, 4) THEN 1 ELSE 0 END)) / 2 + 20 AS y, coalesce(adv, 0) / 2 AS advance FROM s
  UNION ALL SELECT doc_id, page, n, 'page>Fm', 'Tj', 'form', 'A', 0, '0.0 0.0 0.0', 20.0, 17, 23, 20 * (580 + 540 + 660 + 660) / 1000.0 FROM (SELECT DISTINCT doc_id, page, n FROM s))"""
SQL = {
    "page_runs": f"""WITH {_SHOWN} SELECT doc_id, page, CAST(seq AS BIGINT) AS seq, stream, op, text, font, mode, fill, CAST(size AS DOUBLE) AS size, round(CAST(x AS DOUBLE), 4) AS x, round(CAST(y AS DOUBLE), 4) AS y,
  round(CAST(x AS DOUBLE), 4) AS u, round(CAST(y AS DOUBLE), 4) AS v, round(CAST(advance AS DOUBLE), 4) AS advance FROM p""",
    "page_boxes": """WITH p AS (SELECT doc_id, l // 40 AS page, count(*) AS n FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS l FROM documents WHERE text IS NOT NULL) GROUP BY ALL)
SELECT doc_id, page, n + 1 AS seq, 'page>Fm' AS stream, 'path' AS kind, 'S' AS op, CAST(0 AS BIGINT) AS depth, '0.0 0.0 0.0' AS fill, '0.0 0.0 300.0 400.0' AS clip, false AS clip_complex, 7.0::DOUBLE AS x0, 1.0::DOUBLE AS y0, 67.0::DOUBLE AS x1, 49.0::DOUBLE AS y1 FROM p
UNION ALL SELECT doc_id, page, n + 2, 'page', 'path', 'f', 0, '0.375 0.25 0.5', NULL, false, 10.0::DOUBLE, n, 30.0::DOUBLE, n + 30 FROM p
UNION ALL SELECT doc_id, page, n + 3, 'page', 'image', 'Do', 1, '0.375 0.25 0.5', NULL, false, 7.0::DOUBLE, 8.0::DOUBLE, 47.0::DOUBLE, 58.0::DOUBLE FROM p""",
}
