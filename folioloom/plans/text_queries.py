"""Queries over the words and lines of documents, and over conversations as comment threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import comments, compare, search, spelling
from folioloom.sources.tables import staged, table

QUERY, NEW = "the", "THE"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.doc_lines(table(spark, sf_dir, "documents"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.dictionary(table(spark, sf_dir, "documents"))


def dict_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("word", F.explode(text.stems(F.col("word"))).alias("stem"))


def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.unknown_words(spelling.tokens(_lines(spark, sf_dir)), _words(spark, sf_dir))


def foreign_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.foreign(_lines(spark, sf_dir), _words(spark, sf_dir)).select("doc_id", "n", "unknown", "foreign")


def osa_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = staged(_words(spark, sf_dir), "words")
    short = staged(unknown_words(spark, sf_dir), "unknown")
    return spelling.suggestions(short, words)


def run_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = staged(_words(spark, sf_dir), "words")
    return spelling.run_together(staged(spelling.unknown_words(spelling.tokens(_lines(spark, sf_dir)), words), "unknown"), words)


def misspelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.misspellings(_lines(spark, sf_dir), _words(spark, sf_dir))
    return found.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_lines(spark, sf_dir), QUERY).select("doc_id", "line_no", "start", "end")


def search_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = search_hits(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    return per.select("doc_id", "n", search.step_hit(F.lit(0), -1, F.col("n")).alias("before"), search.step_hit(F.col("n") - 1, 1, F.col("n")).alias("after"))


def replace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(search.pattern(QUERY)))
    return docs.select("doc_id", F.md5(search.replaced(F.col("text"), QUERY, NEW)).alias("md5"))


def replace_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second hit of each document that has one replaced, the others left."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(search.pattern(QUERY)))
    return docs.select("doc_id", F.md5(search.replaced(F.col("text"), QUERY, NEW, only=F.lit(1))).alias("md5"))


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("reply_to"), F.col("role").alias("author"), "text")


def comment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.filtered(_comments(spark, sf_dir), author="user", text="the").select("conv_id", "id")


def comment_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to the turn before; every third turn answers one that is not there and begins a thread."""
    rows = _comments(spark, sf_dir).withColumn("reply_to", F.when(F.col("id") % 3 == 2, F.lit(-1)).otherwise(F.col("reply_to")))
    return comments.threads(rows, "conv_id", "id", "reply_to").select("conv_id", "id", "root", F.col("depth").cast("long").alias("depth"))


def comment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same threads as they are shown, with times that do not follow the turns."""
    rows = _comments(spark, sf_dir).withColumn("reply_to", F.when(F.col("id") % 3 == 2, F.lit(-1)).otherwise(F.col("reply_to"))).withColumn("written", F.col("id") * 7 % 5)
    return comments.in_display_order(comments.threads(rows, "conv_id", "id", "reply_to"), "conv_id", "id", "written").select("conv_id", "root", "place", "id")


def comment_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.authors(_comments(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        dict_build, stems, unknown_words, foreign_docs, search_hits, search_step,
        osa_suggest, run_together, misspelling_groups, replace_text, replace_hit, comment_filter, comment_threads, comment_order, comment_authors,
    )
}

_DICT = "d AS (SELECT word, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents) WHERE length(word) >= 2 GROUP BY word HAVING count(DISTINCT doc_id) >= 3)"


def _stems_sql(source: str) -> str:
    rules = [
        ("word LIKE '%s'", "word[:-2]"), ("word LIKE '%es'", "word[:-3]"), ("word LIKE '%ies'", "word[:-4] || 'y'"), ("word LIKE '%ed'", "word[:-3]"), ("word LIKE '%ed'", "word[:-2]"),
        ("word LIKE '%ied'", "word[:-4] || 'y'"), ("word LIKE '%ing'", "word[:-4]"), ("word LIKE '%ing'", "word[:-4] || 'e'"), ("word LIKE '%ly'", "word[:-3]"),
        ("word LIKE '%er'", "word[:-3]"), ("word LIKE '%est'", "word[:-4]"),
        ("word LIKE '%''s'", "word[:-3]"),
    ]
    doubled = [(f"word LIKE '%{e}' AND length(word) >= {len(e) + 2} AND word[-{len(e) + 1}] = word[-{len(e) + 2}]", f"word[:-{len(e) + 2}]") for e in ("ed", "ing", "er", "est")]
    return " UNION ALL ".join(f"SELECT word, {stem} AS stem FROM {source} WHERE {test}" for test, stem in rules + doubled)


_LINES = "l AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
_MASK = "regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(https?://|www\\.)\\S+', chr(1), 'g'), '\\S+@\\S+', chr(1), 'g'), '(?i)\\b[a-z0-9-]+\\.(com|org|net|edu|gov|io|uk|de|fr)\\b', chr(1), 'g')"
_TOKENS = f"""m AS (SELECT doc_id, line_no, {_MASK} AS m FROM l),
y AS (SELECT doc_id, line_no, regexp_matches(m, '^[A-Za-z]') AS starts, regexp_extract_all(m, '[A-Za-z][A-Za-z'']*') AS found FROM m),
x AS (SELECT doc_id, line_no, starts, unnest(found) AS token, unnest(range(len(found))) AS k FROM y),
t AS (
  SELECT doc_id, line_no, token, lower(regexp_replace(token, '^''+|''+$', '', 'g')) AS word FROM x
  WHERE length(regexp_replace(token, '^''+|''+$', '', 'g')) BETWEEN 3 AND 20 AND NOT (length(token) > 1 AND token = upper(token)) AND (NOT regexp_matches(token, '^[A-Z]') OR (starts AND k = 0))),
w AS (SELECT DISTINCT word FROM t),
f AS (SELECT word, word AS stem FROM w UNION ALL SELECT * FROM ({_stems_sql('w')}) WHERE length(stem) >= 2),
g AS (SELECT DISTINCT f.word FROM f JOIN d ON d.word = f.stem),
u AS (SELECT w.word FROM w ANTI JOIN g ON w.word = g.word)"""
_HITS = "h AS (SELECT doc_id, line_no, regexp_split_to_array(text, '(?i)the') AS p FROM l WHERE regexp_matches(text, '(?i)the'))"

SQL = {
    "dict_build": f"WITH {_DICT} SELECT * FROM d",
    "stems": f"WITH {_DICT} {_stems_sql('d')}",
    "unknown_words": f"WITH {_DICT}, {_LINES}, {_TOKENS} SELECT word FROM u",
    "foreign_docs": f"""WITH {_DICT}, {_LINES}, {_TOKENS}
SELECT doc_id, count(*) AS n, CAST(count(u.word) AS BIGINT) AS unknown, count(u.word) / CAST(count(*) AS DOUBLE) > 0.25 AS "foreign" FROM t LEFT JOIN u USING (word) GROUP BY doc_id""",
    "search_hits": f"""WITH {_LINES}, {_HITS}
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 3 * (k - 1) AS INT) AS start, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 3 * k AS INT) AS "end"
FROM (SELECT *, unnest(range(1, len(p))) AS k FROM h)""",
    "search_step": f"WITH {_LINES}, {_HITS} SELECT doc_id, CAST(sum(len(p) - 1) AS BIGINT) AS n, CAST(sum(len(p) - 1) - 1 AS BIGINT) AS before, CAST(0 AS BIGINT) AS after FROM h GROUP BY doc_id",
    "replace_text": "SELECT doc_id, md5(regexp_replace(text, '(?i)the', 'THE', 'g')) AS md5 FROM documents WHERE regexp_matches(text, '(?i)the')",
    "replace_hit": """SELECT doc_id, md5(CASE WHEN len(p) > 2 THEN array_to_string(p[1:1], '') || text[length(p[1]) + 1:length(p[1]) + 3] || p[2] || 'THE' || text[length(p[1]) + length(p[2]) + 7:] ELSE text END) AS md5
FROM (SELECT doc_id, text, regexp_split_to_array(text, '(?i)the') AS p FROM documents WHERE regexp_matches(text, '(?i)the'))""",
    "comment_filter": "SELECT conv_id, turn AS id FROM conversations WHERE role = 'user' AND contains(lower(text), 'the')",
    "comment_order": """WITH RECURSIVE c AS (SELECT conv_id, turn AS id, CASE WHEN turn % 3 = 2 THEN -1 WHEN turn > 0 THEN turn - 1 END AS p FROM conversations),
t AS (
  SELECT conv_id, id, id AS root, CAST(0 AS BIGINT) AS depth FROM c WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM c q WHERE q.conv_id = c.conv_id AND q.id = c.p)
  UNION ALL SELECT c.conv_id, c.id, t.root, t.depth + 1 FROM c JOIN t ON c.conv_id = t.conv_id AND c.p = t.id)
SELECT conv_id, root, row_number() OVER (PARTITION BY conv_id, root ORDER BY depth > 0, CASE WHEN depth > 0 THEN id * 7 % 5 END, depth, id) AS place, id FROM t""",
    "comment_threads": """WITH RECURSIVE c AS (SELECT conv_id, turn AS id, CASE WHEN turn % 3 = 2 THEN -1 WHEN turn > 0 THEN turn - 1 END AS p FROM conversations),
t AS (
  SELECT conv_id, id, id AS root, CAST(0 AS BIGINT) AS depth FROM c WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM c q WHERE q.conv_id = c.conv_id AND q.id = c.p)
  UNION ALL SELECT c.conv_id, c.id, t.root, t.depth + 1 FROM c JOIN t ON c.conv_id = t.conv_id AND c.p = t.id)
SELECT conv_id, id, root, depth FROM t""",
    "comment_authors": "SELECT DISTINCT role AS author FROM conversations WHERE role <> ''",
}
