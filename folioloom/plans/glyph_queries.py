"""Fonts' code maps from CMap streams made of each document's characters, and lines written in the codes of fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, glyphs
from ..sources.tables import table
from .replay_queries import PAGE, PAGE_LINES, _fonts


def _utf16(c) -> F.Column:
    return F.concat(F.lit("<"), F.hex(F.encode(c, "UTF-16BE")), F.lit(">"))


def font_code_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's CMap says: its characters in order from code 1, ten that follow its first one, its first and last in an array, and two names, one of which says nothing."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.array_sort(F.array_distinct(F.split("text", ""))).alias("cs"))
    each = F.array_join(F.transform("cs", lambda c, i: F.concat(F.lit("<"), F.lpad(F.hex(i + 1), 4, F.lit("0")), F.lit("> "), _utf16(c))), "\n")
    first, last = _utf16(F.get("cs", 0)), _utf16(F.element_at("cs", -1))
    content = F.concat(
        F.lit("/CIDInit /ProcSet findresource begin 9 beginbfchar\n"), each, F.lit("\nendbfchar 2 beginbfrange <1000> <1009> "), first, F.lit(" <2000> <2001> ["), first, last,
        F.lit("] endbfrange 2 beginbfchar <0001> /uni0041.alt <0002> /nothing <30> endbfchar end"),
    )
    found = glyphs.code_map(glyphs.cmap_ranges(docs.select("doc_id", content.alias("content")), "content", "doc_id"), ["doc_id"])
    return found.select("doc_id", "code", F.conv(F.hex(F.encode("glyph", "UTF-16BE")), 16, 10).cast("long").alias("unit"))


def line_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line in the codes of one of two fonts, one of which lacks spaces and all but ASCII and has codes for some groups of letters: width, glyphs, what is missing, and a digest of codes and gaps."""
    fonts, known = _fonts(spark, sf_dir)
    groups = spark.createDataFrame([("A", 1, "sch", 900.0), ("A", 2, "ch", 800.0), ("A", 3, "en", 700.0), ("A", 4, "e", 1.0)], "font string, code long, glyph string, width double")
    known = known.where("font <> 'A' or code not in (32, 101)").unionByName(groups)
    lines = compare.doc_lines(table(spark, sf_dir, "documents"))
    font = F.when((F.col("doc_id") + F.col("line_no")) % 2 == 0, "A").otherwise("B")
    texts = lines.select("doc_id", F.floor(F.col("line_no") / PAGE_LINES).alias("page"), F.col("line_no").cast("long").alias("id"), font.alias("font"), "text")
    found = glyphs.encoded(texts, fonts.withColumn("space_width", F.lit(None).cast("double")), known, PAGE, salts=glyphs.SALTS * table(spark, sf_dir, "documents").rdd.getNumPartitions())
    digest = F.md5(F.array_join(F.transform("parts", lambda p: F.when(p["value"].isNull(), "_").otherwise(F.hex(p["value"]))), ""))
    return found.select("doc_id", F.col("id").alias("line_no"), "font", "n_glyphs", "width", F.array_join(F.array_sort("missing"), "").alias("missing"), F.size("spans").cast("long").alias("n_spans"), digest.alias("codes_md5"))


QUERIES = {f.__name__: f for f in (font_code_maps, line_codes)}
SQL = {
    "font_code_maps": """WITH d AS (SELECT doc_id, list_sort(list_distinct(list_transform(string_split(text, ''), lambda c: ord(c)))) AS u FROM documents WHERE text <> '')
SELECT doc_id, CAST(i AS BIGINT) AS code, CAST(CASE WHEN i = 1 THEN 65 ELSE u[i] END AS BIGINT) AS unit FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM d)
UNION ALL SELECT doc_id, 4096 + k, u[1] + k FROM d, range(10) t(k) UNION ALL SELECT doc_id, 8192, u[1] FROM d UNION ALL SELECT doc_id, 8193, u[-1] FROM d""",
    "line_codes": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, CASE WHEN (doc_id + line_no) % 2 = 0 THEN 'A' ELSE 'B' END AS font FROM l),
p AS (SELECT *, CASE font WHEN 'A' THEN regexp_extract_all(text, 'sch|ch|en|[\s\S]') ELSE regexp_extract_all(text, '[\s\S]') END AS ps FROM f),
q AS (SELECT *, list_filter(ps, lambda x: font = 'A' AND NOT regexp_matches(x, '^[ -~]+$')) AS miss, list_transform(list_filter(ps, lambda x: x <> ' '), lambda x: font = 'B' OR regexp_matches(x, '^[!-~]+$')) AS ok FROM p),
s AS (SELECT *, CASE WHEN starts_with(text, ' ') THEN list_concat([true], ok) ELSE ok END AS st FROM q)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, font, CAST(len(list_filter(ps, lambda x: font = 'B' OR regexp_matches(x, '^[!-~]+$'))) AS BIGINT) AS n_glyphs,
  CASE WHEN len(miss) = 0 THEN CAST(coalesce(list_sum(list_transform(ps, lambda x: CASE WHEN font = 'B' THEN 1000 - ord(x) % 3 * 100 WHEN x = 'sch' THEN 900 WHEN x = 'ch' THEN 800 WHEN x = 'en' THEN 700 WHEN x = 'e' THEN 1 WHEN x = ' ' THEN 250 ELSE 500 + ord(x) % 5 * 40 END)), 0) AS DOUBLE) END AS width,
  array_to_string(list_sort(list_distinct(miss)), '') AS missing,
  CAST(CASE WHEN len(st) = 0 THEN 0 ELSE 1 + len(list_filter(list_zip(st[1:len(st) - 1], st[2:]), lambda z: z[1] <> z[2])) END AS BIGINT) AS n_spans,
  CASE WHEN len(miss) = 0 THEN md5(array_to_string(list_transform(ps, lambda x: CASE WHEN font = 'B' THEN printf('%04X', ord(x)) WHEN x = 'sch' THEN '01' WHEN x = 'ch' THEN '02' WHEN x = 'en' THEN '03' WHEN x = 'e' THEN '04' WHEN x = ' ' THEN '_' ELSE printf('%02X', ord(x)) END), '')) END AS codes_md5 FROM s""",
}
