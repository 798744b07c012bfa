"""Queries over pages, points, files, forms, pictures and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import files, forms, geometry, preflight
from folioloom.sources.tables import table
from folioloom.streaming import edits


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.findings(table(spark, sf_dir, "pages"), "page_id", preflight.html_rules(F.col("html")))


def preflight_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


def preflight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.totals(_found(spark, sf_dir), "page_id")


def preflight_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.totals(_found(spark, sf_dir), "page_id").withColumn("rank", preflight.rank(F.col("severity")).cast("long")).select("what", "rank", "count").orderBy("rank", F.desc("count"), "what")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get(e, 2 * k).alias("x"), F.get(e, 2 * k + 1).alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", pairs.alias("points"))


def path_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).select("vec_id", F.explode("points").alias("p")).select("vec_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))
    return geometry.bounding_boxes(rows, "vec_id")


def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir)
    return rows.select("vec_id", F.round(geometry.path_length(F.col("points")), 5).alias("length"), F.round(geometry.path_length(F.col("points"), True), 5).alias("perimeter"))


def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("vec_id", F.round(geometry.polygon_area(F.col("points")), 5).alias("area"))


def box_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = path_bbox(spark, sf_dir)
    clip = tuple(map(F.lit, (-0.2, -0.2, 0.2, 0.2)))
    own = tuple(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
    return box.select("vec_id", geometry.contains(clip, own, 0.1).alias("inside"))


def shape_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    points = geometry.ellipse(F.lit(0.0), F.lit(0.0), F.col("s"), F.col("s") * 2)
    return sizes.select("p_partkey", F.posexplode(points).alias("k", "p")).select("p_partkey", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


def doc_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc32"))


def zip_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a thousand doc_ids as one archive."""
    docs = table(spark, sf_dir, "documents").withColumn("archive", F.floor(F.col("doc_id") / 1000)).withColumn("name", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return files.zip_offsets(docs, "archive", "doc_id", "name", F.octet_length("text")).select("archive", "doc_id", "offset")


def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key, vector = F.unhex(F.md5(F.col("doc_id").cast("string"))), F.unhex(F.md5(F.concat(F.lit("v"), F.col("doc_id").cast("string"))))
    back = files.decrypted(files.encrypted(F.encode("text", "UTF-8"), key, vector), key)
    return docs.select("doc_id", F.md5(back).alias("md5"))


def form_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as fields; every third gets a new value, some are locked, some values have no field."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    fields = c.where(key % 10 != 7).select(key.alias("file"), F.lit("name").alias("field"), F.col("c_name").alias("value"), (key % 5 == 0).alias("read_only"), F.when(key % 2 == 0, 12).alias("max_length"))
    values = c.where(key % 3 == 0).select(key.alias("file"), F.lit("name").alias("field"), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("New "), F.col("c_name"))).alias("new"))
    return forms.filled(fields, values)


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("name"))
    return forms.unique_names(names, "c_nationkey", "c_custkey").select("c_custkey", "unique")


def image_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("w", F.col("p_size") * 40).withColumn("h", F.col("p_size") * 30).withColumn("drawn", (F.col("p_partkey") % 600 + 1).cast("double"))
    return p.withColumn("t", forms.target_pixels(F.col("w"), F.col("h"), F.col("drawn"))).where("t is not null").select("p_partkey", "t.width", "t.height")


def latest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return edits.latest(log, "user_id", "event_id")


def undo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth of the whole log's edits undone."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    last = log.agg(F.max("event_id")).first()[0]
    return edits.latest(log, "user_id", "event_id", upto=None if last is None else last * 9 // 10)


def session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edits.quiet_periods(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def asof_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event of a user the last purchase at or before it: one pass over a user's events in order."""
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(order).alias("heading"))


def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.plain_number(F.col("o_totalprice")).alias("plain"))


QUERIES = {
    f.__name__: f
    for f in (
        preflight_rules, preflight_counts, preflight_rank, path_bbox, polyline_length, polygon_area, box_contains, shape_ellipse, doc_hashes, doc_crc32, zip_offsets,
        aes_roundtrip, form_apply, unique_names, image_targets, latest_edits, undo_state, session_debounce, asof_heading, number_text,
    )
}

_FOUND = r"""r AS (
  SELECT page_id, unnest([
    {what: 'no language', severity: 'warning', count: CASE WHEN regexp_matches(html, '(?i)<html[^>]*\slang=') THEN 0 ELSE 1 END},
    {what: 'no title', severity: 'warning', count: CASE WHEN regexp_matches(html, '(?i)<title>\s*\S') THEN 0 ELSE 1 END},
    {what: 'script', severity: 'error', count: len(regexp_extract_all(html, '(?i)<script[\s>]'))},
    {what: 'frame', severity: 'error', count: len(regexp_extract_all(html, '(?i)<i?frame[\s>]'))},
    {what: 'form', severity: 'note', count: len(regexp_extract_all(html, '(?i)<form[\s>]'))},
    {what: 'picture without words', severity: 'note', count: len(regexp_extract_all(html, '(?i)<img\b')) - len(regexp_extract_all(html, '(?i)<img\b[^>]*\salt='))}]) AS f FROM pages),
f AS (SELECT page_id, f.what AS what, f.severity AS severity, CAST(f.count AS BIGINT) AS count FROM r WHERE f.count > 0)"""
_POINTS = "p AS (SELECT vec_id, k, CAST(embedding[2 * k + 1] AS DOUBLE) AS x, CAST(embedding[2 * k + 2] AS DOUBLE) AS y FROM embeddings, range(32) r(k)), n AS (SELECT *, lead(x) OVER o AS x1, lead(y) OVER o AS y1, first_value(x) OVER o AS x0, first_value(y) OVER o AS y0 FROM p WINDOW o AS (PARTITION BY vec_id ORDER BY k))"
_BOX = "SELECT vec_id, min(round(x, 6)) AS min_x, min(round(y, 6)) AS min_y, max(round(x, 6)) AS max_x, max(round(y, 6)) AS max_y FROM p GROUP BY vec_id"
SQL = {
    "preflight_rules": f"WITH {_FOUND} SELECT * FROM f",
    "preflight_counts": f"WITH {_FOUND} SELECT what, severity, CAST(sum(count) AS BIGINT) AS count, count(DISTINCT page_id) AS n_docs FROM f GROUP BY ALL",
    "preflight_rank": f"WITH {_FOUND} SELECT what, CAST(CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS BIGINT) AS rank, CAST(sum(count) AS BIGINT) AS count FROM f GROUP BY what, severity",
    "path_bbox": f"WITH {_POINTS} {_BOX}",
    "polyline_length": f"WITH {_POINTS} SELECT vec_id, round(sum(sqrt((x1 - x) ** 2 + (y1 - y) ** 2)), 5) AS length, round(sum(sqrt((coalesce(x1, x0) - x) ** 2 + (coalesce(y1, y0) - y) ** 2)), 5) AS perimeter FROM n GROUP BY vec_id",
    "polygon_area": f"WITH {_POINTS} SELECT vec_id, round(abs(sum(x * coalesce(y1, y0) - coalesce(x1, x0) * y)) / 2, 5) AS area FROM n GROUP BY vec_id",
    "box_contains": f"WITH {_POINTS}, b AS ({_BOX}) SELECT vec_id, -0.2::DOUBLE - 0.1::DOUBLE <= min_x AND -0.2::DOUBLE - 0.1::DOUBLE <= min_y AND 0.2::DOUBLE + 0.1::DOUBLE >= max_x AND 0.2::DOUBLE + 0.1::DOUBLE >= max_y AS inside FROM b",
    "shape_ellipse": "SELECT p_partkey, CAST(k AS INT) AS k, round(p_size / 2.0::DOUBLE * (1 + cos(2 * pi() * k / 48)), 6) AS x, round(p_size * (1 + sin(2 * pi() * k / 48)), 6) AS y FROM part, range(48) r(k)",
    "doc_hashes": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "zip_offsets": "SELECT doc_id // 1000 AS archive, doc_id, CAST(coalesce(sum(30 + length('doc-' || doc_id || '.txt') + strlen(text)) OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents",
    "aes_roundtrip": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "form_apply": """WITH f AS (SELECT c_custkey AS file, c_name AS value, c_custkey % 5 = 0 AS ro, CASE WHEN c_custkey % 2 = 0 THEN 12 END AS m FROM customer WHERE c_custkey % 10 <> 7),
v AS (SELECT c_custkey AS file, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'New ' || c_name END AS new FROM customer WHERE c_custkey % 3 = 0),
o AS (SELECT file, value, new, m, CASE WHEN ro IS NULL THEN 'missing' WHEN new IS NULL THEN 'kept' WHEN ro THEN 'read only' WHEN new = '' THEN 'cleared' ELSE 'filled' END AS outcome FROM f FULL JOIN v USING (file))
SELECT file, 'name' AS field, CASE WHEN outcome IN ('filled', 'cleared') THEN CASE WHEN m IS NULL THEN new ELSE new[1:m] END ELSE value END AS value, outcome FROM o""",
    "unique_names": "SELECT c_custkey, CASE WHEN n = 1 THEN name ELSE name || ' ' || n END AS \"unique\" FROM (SELECT c_custkey, c_mktsegment AS name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)",
    "image_targets": """WITH p AS (SELECT p_partkey, p_size * 40 AS w, p_size * 30 AS h, floor(CAST(p_partkey % 600 + 1 AS DOUBLE) / 72 * 150 + 0.5) AS t FROM part)
SELECT p_partkey, CAST(greatest(t, 1) AS BIGINT) AS width, CAST(greatest(floor(h * greatest(t, 1) / w + 0.5), 1) AS BIGINT) AS height FROM p WHERE w > greatest(t, 1) * 1.1::DOUBLE""",
    "latest_edits": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "undo_state": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id <= (SELECT max(event_id) * 9 // 10 FROM events) GROUP BY user_id",
    "number_text": """WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice * 1000 + 0.5::DOUBLE) AS BIGINT) AS t FROM orders)
SELECT o_orderkey, regexp_replace(regexp_replace(t // 1000 || '.' || lpad(CAST(t % 1000 AS VARCHAR), 3, '0'), '0+$', ''), '[.]$', '') AS plain FROM t""",
    "session_debounce": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "asof_heading": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS heading FROM events",
}
