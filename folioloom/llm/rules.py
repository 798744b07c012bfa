"""Quality rules whose thresholds come from quantile sketches of each language and source, with DataFrame functions only.

A sketch is a histogram of shares in steps of 1/10,000 (and of mean word lengths in hundredths): counts by bin add up over
any split of the data, so sketches merge exactly, and a quantile is known to a step. A measure's upper threshold in a group is
its third quartile plus ``FENCE`` times the spread of its quartiles, the spread at least the measure's ``least``; word length
has a lower one too. A group of fewer than ``GROUP_ROWS`` rows takes the merged sketch of its language, and a language of
fewer that of all rows. Documents are then joined with their group's thresholds and filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import checked, written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
RUN = 5
FENCE, GROUP_ROWS = 3, 100
#: Measures by name: numerator, denominator, steps of one, least spread in steps, whether low values fail too.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 10_000, 500, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 500, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, 300, False),
    "word_length": ("word_chars", "n_words", 100, 50, True),
}


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) of each whole text.

    A null text has no words. n_lines: lines with a word. n_repeat_words: words in runs of five that the text holds twice or more.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_text", text)
    trimmed = F.regexp_replace("_text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_words", words)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", lines)
    runs = F.when(
        F.size("_words") >= RUN,
        F.transform(F.sequence(F.lit(0), F.size("_words") - RUN), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(RUN)))),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_runs", runs)
    # only texts that hold a run twice need the places: runs sorted with their places, equal neighbours marked
    placed = F.sort_array(F.zip_with("_runs", F.sequence(F.lit(0), F.size("_runs") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_twice", F.size(F.array_distinct("_runs")) < F.size("_runs"))
    rows = rows.withColumn("_sorted", F.when(F.col("_twice"), placed))
    at = lambda k: F.get("_sorted", k)["h"]
    here = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda k: F.coalesce(at(k) == at(k + 1), F.lit(False)) | F.coalesce(at(k) == at(k - 1), F.lit(False)))
    starts = F.sort_array(F.transform(here, lambda k: F.get("_sorted", k)["i"]))
    rows = rows.withColumn("_starts", F.when(F.col("_twice"), starts))
    # each run covers its words up to where the next one begins
    n = F.size("_starts")
    covered = F.aggregate(
        F.zip_with("_starts", F.slice("_starts", F.lit(2), n), lambda a, b: F.least(F.coalesce(b, a + RUN) - a, F.lit(RUN))), F.lit(0), lambda total, x: total + x
    )
    symbols = F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))
    return (
        rows.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long"))
        .withColumn("n_symbols", symbols.cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("_twice"), covered).otherwise(0).cast("long"))
        .drop("_text", "_words", "_lines", "_runs", "_twice", "_sorted", "_starts")
    )


def bin_of(name: str) -> F.Column:
    over, under, steps, _, _ = MEASURES[name]
    return F.when(F.col(under) > 0, F.floor(F.col(over) * steps / F.col(under)).cast("long"))


def thresholds(counted: DataFrame) -> DataFrame:
    """``(lang, source, <measure>_high, word_length_low)``, one row for each language and source that occur, nulls among them."""
    bins = counted.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(m).alias("bin")) for m in MEASURES))).alias("b"))
    sketch = bins.where("b.bin is not null").groupBy("lang", "source", "b.measure", "b.bin").agg(F.count("*").alias("n"))
    levels = sketch.select(
        "measure", "bin", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), a.alias("l"), b.alias("s")) for k, a, b in (
            (2, F.col("lang"), F.col("source")), (1, F.col("lang"), F.lit(None).cast("string")), (0, F.lit(None).cast("string"), F.lit(None).cast("string")))))).alias("g")
    )
    merged = levels.groupBy("g.level", "g.l", "g.s", "measure", "bin").agg(F.sum("n").alias("n"))
    group = ["level", "l", "s", "measure"]
    up = merged.withColumn("upto", F.sum("n").over(W.partitionBy(*group).orderBy("bin"))).withColumn("all", F.sum("n").over(W.partitionBy(*group)))
    cut = up.groupBy(*group).agg(F.max("all").alias("rows"), F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bin"))).alias("q1"), F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bin"))).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.create_map(*(F.lit(x) for m, v in MEASURES.items() for x in (m, v[3])))[F.col("measure")])
    fence = cut.select(*group, "rows", (F.col("q3") + FENCE * spread).alias("high"), (F.col("q1") - FENCE * spread).alias("low"))
    own = counted.select("lang", "source").distinct().crossJoin(F.broadcast(counted.sparkSession.createDataFrame([(m,) for m in MEASURES], "measure string")))
    for level in (2, 1, 0):
        part = fence.where((F.col("level") == level) & ((F.col("rows") >= GROUP_ROWS) | F.lit(level == 0)))
        part = part.select(F.col("l").alias("_l"), F.col("s").alias("_s"), F.col("measure").alias("_m"), F.col("high").alias(f"h{level}"), F.col("low").alias(f"w{level}"))
        same = F.col("measure") == F.col("_m")
        same = same & F.col("lang").eqNullSafe(F.col("_l")) if level else same
        same = same & F.col("source").eqNullSafe(F.col("_s")) if level == 2 else same
        own = own.join(part, same, "left").drop("_l", "_s", "_m")
    own = own.withColumn("high", F.coalesce("h2", "h1", "h0")).withColumn("low", F.coalesce("w2", "w1", "w0"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return own.groupBy("lang", "source").agg(*(pick(m, "high").alias(f"{m}_high") for m in MEASURES), *(pick(m, "low").alias(f"{m}_low") for m, v in MEASURES.items() if v[4]))


def judged(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """``docs`` (or only its columns ``carried``) with the base counts, base_failed and kept.

    base_failed: fewer than 10 words, or over 20 % of words repeated in runs. kept: not so, and each measure inside its group's
    thresholds. Null or empty texts fail; a null lang or source is a group of its own; repeated rows are judged alike; an
    empty table gives an empty result. Columns of these names in ``docs`` are replaced; others may have any name.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    columns = [c for c in (docs.columns if carried is None else carried) if c not in (*counts, "base_failed", "kept")]
    packed = docs.select(F.struct(*columns).alias("_row"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    # texts are counted once; thresholds and verdicts read the table
    counted = written(base_counts(packed).drop("text"), "counts")
    limits = thresholds(counted.drop("_row")).withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    joined = counted.join(checked(limits), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fine = F.lit(True)
    for m, v in MEASURES.items():
        fine = fine & F.coalesce(bin_of(m) <= F.col(f"{m}_high"), F.lit(True))
        fine = fine & F.coalesce(bin_of(m) >= F.col(f"{m}_low"), F.lit(True)) if v[4] else fine
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select(*(F.col("_row")[c].alias(c) for c in columns), *counts, failed.alias("base_failed"), (~failed & fine).alias("kept"))


def _sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    checks = " AND ".join(
        f"coalesce(CASE WHEN {under} > 0 THEN {over} * {steps} // {under} END <= (SELECT high FROM lim t WHERE t.measure = '{m}' AND t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source), true)"
        + (f" AND coalesce(CASE WHEN {under} > 0 THEN {over} * {steps} // {under} END >= (SELECT low FROM lim t WHERE t.measure = '{m}' AND t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source), true)" if low else "")
        for m, (over, under, steps, _, low) in MEASURES.items()
    )
    measures = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, {least} AS least, {over} * {steps} // {under} AS bin FROM c WHERE {under} > 0" for m, (over, under, steps, least, _) in MEASURES.items()
    )
    return f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
r AS (
  SELECT *, list_transform(range(len(words) - {RUN - 1}), lambda i: words[i + 1:i + {RUN}]) AS runs,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM w),
g AS (SELECT doc_id, run, list(i) AS spots FROM (SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS i FROM r) GROUP BY doc_id, run HAVING count(*) > 1),
p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, i + k AS place FROM (SELECT doc_id, unnest(spots) AS i FROM g), range({RUN}) k(k)) GROUP BY doc_id),
c AS (
  SELECT r.doc_id, lang, source, len(words) AS n_words, len(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    len(t) - len(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM r LEFT JOIN p USING (doc_id)),
m AS ({measures}),
lv AS (
  SELECT 2 AS level, lang, source, measure, least, bin FROM m UNION ALL SELECT 1, lang, NULL, measure, least, bin FROM m UNION ALL SELECT 0, NULL, NULL, measure, least, bin FROM m),
q AS (
  SELECT level, lang, source, measure, any_value(least) AS least, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM lv GROUP BY ALL),
f AS (SELECT *, q3 + {FENCE} * greatest(q3 - q1, least) AS high, q1 - {FENCE} * greatest(q3 - q1, least) AS low FROM q),
lim AS (
  SELECT g.lang, g.source, f0.measure, coalesce(f2.high, f1.high, f0.high) AS high, coalesce(f2.low, f1.low, f0.low) AS low
  FROM (SELECT DISTINCT lang, source FROM c) g JOIN f f0 ON f0.level = 0
  LEFT JOIN f f1 ON f1.level = 1 AND f1.n >= {GROUP_ROWS} AND f1.measure = f0.measure AND f1.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN f f2 ON f2.level = 2 AND f2.n >= {GROUP_ROWS} AND f2.measure = f0.measure AND f2.lang IS NOT DISTINCT FROM g.lang AND f2.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {checks} AS kept
FROM c
"""


SQL = _sql()
