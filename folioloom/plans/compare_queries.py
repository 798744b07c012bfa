"""Queries over versions of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.text import norm_key
from folioloom.operators import compare
from folioloom.sources.tables import table

_SPACES = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_LINES = f"""
l AS (
  SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, line_no, line_no // 20 AS page_no, text, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS k, doc_id // 2 AS pair, doc_id % 2 AS side FROM l)"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.doc_lines(table(spark, sf_dir, "documents"))


def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.doc_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", norm_key(F.col("text")).alias("key"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = compare.doc_lines(table(spark, sf_dir, "documents")).withColumn("key", norm_key(F.col("text")))
    return lines.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n > 1")


def lang_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    per = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return per.crossJoin(F.broadcast(docs.agg(F.count("*").alias("_all")))).select("lang", "n", "chars", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def dice_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.document_similarity(table(spark, sf_dir, "documents"))


def page_bag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.page_similarity(table(spark, sf_dir, "documents"))


def page_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.page_alignment(table(spark, sf_dir, "documents"))


def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.line_changes(table(spark, sf_dir, "documents"))


def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.change_summary(table(spark, sf_dir, "documents"))


QUERIES = {
    "doc_lines": doc_lines,
    "norm_key": norm_keys,
    "line_counts": line_counts,
    "lang_share": lang_share,
    "dice_similarity": dice_similarity,
    "page_bag_overlap": page_bag_overlap,
    "page_align": page_align,
    "line_diff": line_diff,
    "compare_summary": compare_summary,
}

SQL = {
    "doc_lines": f"WITH {_LINES} SELECT doc_id, CAST(page_no AS INT) AS page_no, CAST(line_no AS INT) AS line_no, text FROM k",
    "norm_key": f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, k AS key FROM k",
    "line_counts": f"WITH {_LINES} SELECT k AS key, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY k HAVING count(*) > 1",
    "lang_share": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM documents), 6) AS share FROM documents GROUP BY lang",
    "dice_similarity": f"""WITH {_LINES},
n AS (SELECT pair, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM k GROUP BY pair),
c AS (SELECT pair, side, k, count(*) AS c FROM k WHERE k <> '' GROUP BY ALL),
s AS (SELECT a.pair, sum(least(a.c, b.c)) AS shared FROM c a JOIN c b ON a.pair = b.pair AND a.k = b.k AND a.side = 0 AND b.side = 1 GROUP BY a.pair)
SELECT n.pair, round(2.0 * CAST(coalesce(shared, 0) AS DOUBLE) / CAST(n0 + n1 AS DOUBLE), 6) AS similarity FROM n LEFT JOIN s USING (pair) WHERE n0 > 0 AND n1 > 0""",
    "page_bag_overlap": f"""WITH {_LINES},
n AS (SELECT pair, side, page_no, count(*) AS n FROM k GROUP BY ALL),
c AS (SELECT pair, side, page_no, k, count(*) AS c FROM k WHERE k <> '' GROUP BY ALL),
s AS (SELECT a.pair, a.page_no AS p0, b.page_no AS p1, sum(least(a.c, b.c)) AS shared FROM c a JOIN c b ON a.pair = b.pair AND a.k = b.k AND a.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT s.pair, CAST(p0 AS INT) AS page_mine, CAST(p1 AS INT) AS page_theirs, round(2.0 * CAST(shared AS DOUBLE) / CAST(x.n + y.n AS DOUBLE), 6) AS similarity
FROM s JOIN n x ON x.pair = s.pair AND x.side = 0 AND x.page_no = p0 JOIN n y ON y.pair = s.pair AND y.side = 1 AND y.page_no = p1""",
}
