"""Queries over tokens, ranges, lines, page plans and the small units of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import compare, content, files, forms, geometry, lexer, pages
from folioloom.sources.tables import is_image, table


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of each document as a content stream of one of six forms: escaped, nested, hexadecimal, in an array, behind a comment, and as an inline image."""
    lines = compare.doc_lines(table(spark, sf_dir, "documents"))
    own = F.regexp_replace("text", r"([\\()])", r"\\$1")
    forms = (
        F.concat(F.lit("BT /F#20"), F.col("line_no").cast("string"), F.lit(" 5-3 Tf ("), own, F.lit(") Tj ET")),
        F.concat(F.lit("(("), own, F.lit("))Tj")),
        F.concat(F.lit("<"), F.hex("text"), F.lit(">Tj")),
        F.concat(F.lit("[("), own, F.lit(")-12.5("), own, F.lit(")]TJ")),
        F.concat(F.lit("% "), F.regexp_replace("text", "\r", ""), F.lit("\n(x)'")),
        F.concat(F.lit("BI /W 4 ID "), F.hex("text"), F.lit("\nEI Q")),
    )
    kind, content = (F.col("doc_id") + F.col("line_no")) % 6, forms[0]
    for k, form in enumerate(forms[1:], 1):
        content = F.when(kind == k, form).otherwise(content)
    return lines.where("text is not null").select("doc_id", "line_no", F.encode(content, "UTF-8").alias("content"))


def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every stream, with its byte places and its value."""
    found = lexer.lexed(_streams(spark, sf_dir), "content", "doc_id", "line_no")
    return found.withColumn("value", F.decode("value", "UTF-8"))


def operator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of token and each operator stands in all streams, and their bytes."""
    found = content_tokens(spark, sf_dir)
    return found.groupBy("kind", F.when(F.col("kind") == "operator", F.col("value")).alias("operator")).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(content.html_tokens(F.col("html"))).alias("at", "token"))


def splice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six patches a document: two at one place, some over others, which ones by doc_id; with how many were dropped, and the last of them."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 20)
    n, first = F.length("text"), F.col("doc_id") % 7
    patch = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(new).alias("new"))
    middle = F.floor(n / 2)
    patches = F.array(patch(first, first + 4, "[d]"), patch(middle, middle, "[z]"), patch(F.lit(0), F.lit(5), "[new]"), patch(middle, middle, "[a]"), patch(F.lit(3), F.lit(8), "[late]"), patch(n - 3, n - 2, ""))
    rows = docs.select("doc_id", content.spliced(F.col("text"), patches).alias("s"))
    return rows.select("doc_id", F.md5("s.text").alias("md5"), F.size("s.dropped").cast("long").alias("n_dropped"), F.element_at("s.dropped", -1)["new"].alias("last_dropped"))


def redact_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line, the third to the sixth character and the fifth to the eighth."""
    lines = compare.doc_lines(table(spark, sf_dir, "documents"))
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    return lines.select("doc_id", "line_no", content.erased(F.col("text"), F.array(span(2, 6), span(4, 8)), "#").alias("text"))


def reflow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = compare.doc_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "line_no", F.posexplode(content.wrapped_lines(F.col("text"), 60)).alias("at", "line"))


def overflow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose words need more than two lines of 60 characters, with how many they need."""
    lines = compare.doc_lines(table(spark, sf_dir, "documents")).withColumn("n", F.size(content.wrapped_lines(F.col("text"), 60)))
    return lines.where("n > 2").select("doc_id", "line_no", F.col("n").cast("long").alias("n"))


def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's prices in line order, the upper median of the steps between them, in hundredths."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    step = F.round(100 * (F.col("l_extendedprice") - F.lag("l_extendedprice").over(order))).cast("long")
    steps = table(spark, sf_dir, "lineitem").withColumn("gap", step).where("gap is not null")
    gaps = steps.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("gap")).alias("g"))
    return gaps.select("l_orderkey", F.get("g", F.floor(F.size("g") / 2).cast("int")).alias("gap"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()


def move_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of each order in front of all others."""
    return pages.reordered(_pages(spark, sf_dir), "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, 0).otherwise(1))


def delete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order without its second page, counted anew."""
    return pages.reordered(_pages(spark, sf_dir).where("l_linenumber <> 2"), "l_orderkey", "l_linenumber", F.col("l_linenumber"))


def insert_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank page behind each even one."""
    return pages.with_blanks(_pages(spark, sf_dir), "l_orderkey", "l_linenumber", F.col("l_linenumber") % 2 == 0)


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pages.split_chunks(_pages(spark, sf_dir), "l_orderkey", "l_linenumber", 2).select("l_orderkey", "chunk").distinct()
    return pages.chunk_names(chunks, "l_orderkey", "chunk", F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")))


def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, sizes and measures as they are shown."""
    p = table(spark, sf_dir, "part")
    colour = F.concat(F.lit("#"), F.lpad(F.hex("p_partkey"), 6, "0"))
    return p.select(
        "p_partkey",
        F.round(text.hex_rgb(colour)["b"], 6).alias("blue"),
        text.family_key(F.col("p_name")).alias("family"),
        text.output_name(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, ".PDF").otherwise("")), "-new").alias("output"),
        text.size_text((F.col("p_partkey") * 1000).cast("long")).alias("size"),
        text.matched_case(F.when(F.col("p_partkey") % 2 == 0, F.lit("Word")).otherwise("word"), F.col("p_name")).alias("corrected"),
        is_image(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, ".JPEG").when(F.col("p_partkey") % 3 == 1, ".png").otherwise(".tif"))).alias("is_image"),
    )


def dos_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.to_timestamp(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", files.dos_time(at).alias("dos"))


def calibrated_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    drawn, real, value = (F.col("p_size") - 1).cast("double"), F.lit(12.5), F.col("p_retailprice")
    return p.select("p_partkey", F.round(geometry.calibrated(drawn, real, value), 6).alias("length"), F.round(geometry.calibrated(drawn, real, value, True), 4).alias("area"))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of line items against one box, as they are and grown by five."""
    q = F.col("l_quantity")
    box = (q, q * 2, q + 5, q * 2 + 5)
    other = tuple(F.lit(float(v)) for v in (20, 30, 40, 60))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.overlaps(box, other).alias("meets"), geometry.overlaps(box, other, 5.0).alias("near"))
    return rows.groupBy("l_orderkey").agg(F.count_if("meets").alias("meets"), F.count_if("near").alias("near"))


def _recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("text"), (F.col("l_discount") * 1000).cast("int").alias("confidence"), F.col("l_quantity").alias("height"), (F.col("l_quantity") * 3).alias("width"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forms.recognised(_recognised(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.round("size", 6).alias("size"), F.round("scale", 6).alias("scale"))


def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.page_confidence(_recognised(spark, sf_dir), "l_orderkey").select("l_orderkey", F.round("confidence", 6).alias("confidence"))


def aes_cipher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cipher text itself; a test holds it against a published answer."""
    key, vector = F.unhex(F.md5(F.col("doc_id").cast("string"))), F.unhex(F.md5(F.concat(F.lit("v"), F.col("doc_id").cast("string"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(files.encrypted(F.encode("text", "UTF-8"), key, vector), 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        content_tokens, operator_counts, html_tokens, splice_text, redact_ranges, reflow_lines, overflow_lines, median_gap, move_pages, delete_pages, insert_blanks, split_names,
        text_units, dos_times, calibrated_lengths, box_overlaps, ocr_words, ocr_confidence, aes_cipher,
    )
}

_PAGES = "p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"
_LINES = "l AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
_WRAPPED = r"""w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM l),
r AS (SELECT doc_id, line_no, CASE WHEN len(words) = 0 THEN '' ELSE list_reduce(words, lambda a, x: a || CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(x) > 60 THEN chr(10) ELSE ' ' END || x) END AS t FROM w)"""
_TOKENS = r"""l AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
e AS (SELECT doc_id, line_no, text, (doc_id + line_no) % 6 AS k, regexp_replace(text, '([\\()])', '\\\1', 'g') AS own FROM l),
p AS (SELECT doc_id, line_no, CASE k
  WHEN 0 THEN [{k: 'operator', r: 'BT', v: 'BT'}, {k: '', r: ' ', v: ''}, {k: 'name', r: '/F#20' || line_no, v: 'F ' || line_no}, {k: '', r: ' ', v: ''}, {k: 'number', r: '5-3', v: '5-3'}, {k: '', r: ' ', v: ''}, {k: 'operator', r: 'Tf', v: 'Tf'}, {k: '', r: ' ', v: ''}, {k: 'string', r: '(' || own || ')', v: text}, {k: '', r: ' ', v: ''}, {k: 'operator', r: 'Tj', v: 'Tj'}, {k: '', r: ' ', v: ''}, {k: 'operator', r: 'ET', v: 'ET'}]
  WHEN 1 THEN [{k: 'string', r: '((' || own || '))', v: '(' || text || ')'}, {k: 'operator', r: 'Tj', v: 'Tj'}]
  WHEN 2 THEN [{k: 'hex', r: '<' || hex(text) || '>', v: text}, {k: 'operator', r: 'Tj', v: 'Tj'}]
  WHEN 3 THEN [{k: 'open', r: '[', v: '['}, {k: 'string', r: '(' || own || ')', v: text}, {k: 'number', r: '-12.5', v: '-12.5'}, {k: 'string', r: '(' || own || ')', v: text}, {k: 'close', r: ']', v: ']'}, {k: 'operator', r: 'TJ', v: 'TJ'}]
  WHEN 4 THEN [{k: '', r: '% ' || replace(text, chr(13), '') || chr(10), v: ''}, {k: 'string', r: '(x)', v: 'x'}, {k: 'operator', r: '''', v: ''''}]
  ELSE [{k: 'image', r: 'BI /W 4 ID ' || hex(text) || chr(10) || 'EI', v: 'BI /W 4 ID ' || hex(text) || chr(10) || 'EI'}, {k: '', r: ' ', v: ''}, {k: 'operator', r: 'Q', v: 'Q'}] END AS parts FROM e),
u AS (SELECT doc_id, line_no, unnest(parts) AS t, unnest(range(len(parts))) AS i FROM p),
w AS (SELECT *, coalesce(sum(strlen(t.r)) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
k AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS n, t.k AS kind, CAST(start AS BIGINT) AS start, CAST(start + strlen(t.r) AS BIGINT) AS "end", t.v AS value, CASE WHEN t.k = 'number' THEN CASE t.v WHEN '5-3' THEN 5.0::DOUBLE ELSE -12.5::DOUBLE END END AS number FROM w WHERE t.k <> '')"""
SQL = {
    "content_tokens": f"WITH {_TOKENS} SELECT * FROM k",
    "operator_counts": f"""WITH {_TOKENS} SELECT kind, CASE WHEN kind = 'operator' THEN value END AS operator, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS bytes FROM k GROUP BY ALL""",
    "html_tokens": r"""WITH t AS (SELECT page_id, list_filter(regexp_extract_all(html, '<!--[\s\S]*?-->|<[^<>]*>|[^<>]+'), lambda x: regexp_matches(x, '\S')) AS t FROM pages)
SELECT page_id, CAST(unnest(range(len(t))) AS INT) AS at, unnest(t) AS token FROM t""",
    "splice_text": """WITH s AS (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS m, doc_id % 7 AS f FROM documents WHERE length(text) >= 20)
SELECT doc_id, md5(CASE WHEN f = 0 THEN '[d]' || text[5:m] WHEN f < 5 THEN '[new]' || text[6:m] ELSE '[new]' || text[6:f] || '[d]' || text[f + 5:m] END || '[z][a]' || text[m + 1:n - 3] || text[n - 1:n]) AS md5,
CAST(CASE WHEN f < 5 THEN 2 ELSE 1 END AS BIGINT) AS n_dropped, CASE WHEN f = 4 THEN '[d]' WHEN f = 3 THEN '[late]' ELSE '[late]' END AS last_dropped FROM s""",
    "redact_ranges": f"WITH {_LINES} SELECT doc_id, line_no, text[1:2] || repeat('#', CAST(greatest(least(length(text), 8) - 2, 0) AS BIGINT)) || text[9:] AS text FROM l",
    "reflow_lines": f"WITH {_LINES}, {_WRAPPED} SELECT doc_id, line_no, CAST(unnest(range(len(string_split(t, chr(10))))) AS INT) AS at, unnest(string_split(t, chr(10))) AS line FROM r",
    "overflow_lines": f"WITH {_LINES}, {_WRAPPED} SELECT doc_id, line_no, len(string_split(t, chr(10))) AS n FROM r WHERE len(string_split(t, chr(10))) > 2",
    "median_gap": """WITH g AS (SELECT l_orderkey, CAST(round(100 * (l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice))) AS BIGINT) AS gap FROM lineitem)
SELECT l_orderkey, list_sort(list(gap))[count(*) // 2 + 1] AS gap FROM g WHERE gap IS NOT NULL GROUP BY l_orderkey""",
    "move_pages": f"WITH {_PAGES} SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber <> 3, l_linenumber) - 1 AS INT) AS pos FROM p",
    "delete_pages": f"WITH {_PAGES} SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INT) AS pos FROM p WHERE l_linenumber <> 2",
    "insert_blanks": f"""WITH {_PAGES}, b AS (SELECT *, 0 AS b FROM p UNION ALL SELECT *, 1 FROM p WHERE l_linenumber % 2 = 0)
SELECT l_orderkey, CASE WHEN b = 0 THEN l_linenumber END AS l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, b) - 1 AS INT) AS pos FROM b""",
    "split_names": f"""WITH {_PAGES}, r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM p),
c AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey, island ORDER BY l_linenumber) - 1) // 2 AS part FROM r),
d AS (SELECT DISTINCT l_orderkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY island, part) AS k FROM c)
SELECT l_orderkey, CAST(k - 1 AS INT) AS chunk, 'order-' || l_orderkey || '-' || lpad(CAST(k AS VARCHAR), CAST(length(CAST(max(k) OVER (PARTITION BY l_orderkey) AS VARCHAR)) AS INT), '0') || '.pdf' AS name FROM d""",
    "text_units": """SELECT p_partkey, round((p_partkey % 256) / 255.0::DOUBLE, 6) AS blue, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS family, p_name || '-new.pdf' AS output,
CASE WHEN p_partkey * 1000 >= 1048576 THEN format('{:.1f} MB', p_partkey * 1000 / 1048576.0::DOUBLE) ELSE CAST(CAST(floor(p_partkey * 1000 / 1024.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || ' KB' END AS size,
CASE WHEN p_partkey % 2 = 0 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS corrected, p_partkey % 3 < 2 AS is_image FROM part""",
    "dos_times": """SELECT event_id, CAST(((greatest(year(ts), 1980) - 1980) * 512 + month(ts) * 32 + day(ts)) AS BIGINT) * 65536 + hour(ts) * 2048 + minute(ts) * 32 + CAST(floor(second(ts)) AS BIGINT) // 2 AS dos FROM events""",
    "calibrated_lengths": """SELECT p_partkey, CASE WHEN p_size > 1 THEN round(p_retailprice * (12.5::DOUBLE / (p_size - 1)), 6) END AS length,
CASE WHEN p_size > 1 THEN round(p_retailprice * ((12.5::DOUBLE / (p_size - 1)) * (12.5::DOUBLE / (p_size - 1))), 4) END AS area FROM part""",
    "box_overlaps": """SELECT l_orderkey, count(*) FILTER (q < 40 AND 20 < q + 5 AND q * 2 < 60 AND 30 < q * 2 + 5) AS meets, count(*) FILTER (q - 5 < 40 AND 20 < q + 10 AND q * 2 - 5 < 60 AND 30 < q * 2 + 10) AS near
FROM (SELECT l_orderkey, l_quantity AS q FROM lineitem) GROUP BY l_orderkey""",
    "ocr_words": """WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS h, length(l_returnflag) AS n, CAST(floor(l_discount * 1000) AS INT) AS c FROM lineitem),
s AS (SELECT *, least(greatest(0.95::DOUBLE * h, 4), 72) AS size FROM w WHERE c >= 40)
SELECT l_orderkey, l_linenumber, l_partkey, round(size, 6) AS size, round(least(greatest(100 * (h * 3) / (n * 0.5::DOUBLE * size), 20), 400), 6) AS scale FROM s""",
    "ocr_confidence": "SELECT l_orderkey, round(avg(CAST(floor(l_discount * 1000) AS INT)), 6) AS confidence FROM lineitem GROUP BY l_orderkey",
}
