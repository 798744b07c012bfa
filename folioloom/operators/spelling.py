"""Spelling against a word list: words known by themselves or a stem, words run together, suggestions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.functions.text import stems
from folioloom.sources.tables import staged

#: Letters of a word that is checked, of one that may be several run together, of such a piece; suggestions; share of unknown words of a foreign text.
SHORTEST, LONGEST, RUN_TOGETHER, PIECE, SUGGESTIONS, FOREIGN = 3, 20, 11, (2, 14), 5, 0.25
#: Addresses, with a sign that each must hold. One with an @ begins where its word does, so a long word is not tried from all its places.
_ADDRESSES = ((r"(?i)\b(https?://|www\.)\S+", "://", "."), (r"(?<!\S)\S+@\S+", "@"), (r"(?i)\b[a-z0-9-]+\.(com|org|net|edu|gov|io|uk|de|fr)\b", "."))


def dictionary(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """``(word, n_docs)``: lower-case words of two letters or more that stand in ``least_docs`` documents."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)))).alias("word")).distinct()
    return words.where(F.length("word") >= 2).groupBy("word").agg(F.count("doc_id").alias("n_docs")).where(F.col("n_docs") >= least_docs)


def tokens(lines: DataFrame) -> DataFrame:
    """``lines`` without text, with token and word of every word to check.

    Addresses are skipped, and so are words under 3 or over 20 letters, words in capitals and capitalised words behind a line's first character.
    """
    rows = lines.withColumn("_m", F.col("text"))
    for pattern, *signs in _ADDRESSES:
        may = reduce(or_, (F.contains(F.col("_m"), F.lit(sign)) for sign in signs))
        rows = rows.withColumn("_m", F.when(may, F.regexp_replace("_m", pattern, "\u0001")).otherwise(F.col("_m")))
    found = rows.select(*lines.drop("text").columns, F.col("_m").rlike("^[A-Za-z]").alias("_starts"), F.posexplode(F.regexp_extract_all("_m", F.lit("[A-Za-z][A-Za-z']*"), F.lit(0))).alias("_k", "token"))
    word = F.lower(F.when(F.col("token").endswith("'"), F.regexp_replace("token", "'+$", "")).otherwise(F.col("token")))  # none begins with one
    first = F.col("_starts") & (F.col("_k") == 0)  # at the line's first character
    fine = F.length("word").between(SHORTEST, LONGEST) & ~((F.length("token") > 1) & (F.col("token") == F.upper("token"))) & (~F.col("token").rlike("^[A-Z]") | first)
    return found.withColumn("word", word).where(fine).drop("_starts", "_k")


def known_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct ``(word)`` of ``words`` that the list has itself or as a stem of two letters or more."""
    forms = words.select("word").distinct().withColumn("form", F.explode(F.concat(F.array("word"), F.filter(stems(F.col("word")), lambda s: F.length(s) >= 2))))
    return forms.join(known.select(F.col("word").alias("form")), "form", "left_semi").select("word").distinct()


def unknown_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct ``(word)`` of ``words`` that the list has neither itself nor as a stem of two letters or more."""
    return words.select("word").distinct().join(known_words(words, known), "word", "left_anti")


def run_together(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """``(word)`` of 11 letters or more that part into two to five known pieces of 2 to 14 letters.

    Rounds of joins: all first pieces of a word meet the list at once, then all that can follow each, so no word is walked by itself.
    """
    start = unknown.where(F.length("word") >= RUN_TOGETHER).select("word", F.lit(0).alias("at"))
    done = None
    for depth in range(1, 6):
        ends = start.withColumn("end", F.explode(F.sequence(F.col("at") + PIECE[0], F.col("at") + PIECE[1]))).where(F.col("end") <= F.length("word"))
        pieces = ends.withColumn("piece", F.substring("word", F.col("at") + 1, F.col("end") - F.col("at")))
        good = known_words(pieces.select(F.col("piece").alias("word")), known)
        start = staged(pieces.join(good.withColumnRenamed("word", "piece"), "piece", "left_semi").select("word", F.col("end").alias("at")).distinct(), "run-together")
        if depth >= 2:
            whole = start.where(F.col("at") == F.length("word")).select("word")
            done = whole if done is None else done.union(whole)
    return done.distinct()


def suggestions(unknown: DataFrame, known: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """``(word, suggestion, place)``: list words one edit away with the same first or second letter, best first.

    Each kind of edit is an equal key on both sides, so words meet that are one edit apart and no others: a word without a
    letter is the other (either way), a word with two neighbours swapped is the other, or both are alike without the letter
    at one place. Words of the same letters come first, then those of the same length, then by the alphabet.
    """
    places = lambda w, less: F.filter(F.sequence(F.lit(1), F.greatest(F.length(w) - less, F.lit(1))), lambda i: i <= F.length(w) - less)
    without = lambda w, i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
    swapped = lambda w, i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1)), F.substring(w, i, F.lit(1)), F.substring(w, i + 2, F.length(w)))
    named = lambda kind, value: F.concat(F.lit(kind), value)
    at_place = lambda w: F.transform(places(w, 0), lambda i: F.concat(i.cast("string"), F.lit(":"), without(w, i)))
    mine, other = F.col("word"), F.col("word")
    left = F.concat(
        F.array(named("less:", mine)),
        F.transform(places(mine, 0), lambda i: named("whole:", without(mine, i))),
        F.transform(places(mine, 1), lambda i: named("whole:", swapped(mine, i))),
        at_place(mine),
    )
    right = F.concat(F.array(named("whole:", other)), F.transform(places(other, 0), lambda i: named("less:", without(other, i))), at_place(other))
    one = unknown.select("word", F.explode(F.array_distinct(left)).alias("key"))
    two = known.select(other.alias("suggestion"), F.explode(F.array_distinct(right)).alias("key"))
    letter = lambda k: F.substring("word", k, 1) == F.substring("suggestion", k, 1)
    # a word has some forty keys, which a planner that knows the size of the words alone would gather at the driver
    near = one.join(two.hint("merge"), "key").where(letter(1) | letter(2)).select("word", "suggestion").distinct()
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    order = W.partitionBy("word").orderBy((letters("suggestion") != letters("word")).cast("int"), F.abs(F.length("suggestion") - F.length("word")), "suggestion")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def misspellings(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, line_no, token)`` of words that are neither known nor run together; a capitalised one needs a suggestion."""
    found = tokens(lines)
    known = staged(known.select("word"), "words")
    strange = staged(unknown_words(found, known), "unknown")
    strange = staged(strange.join(run_together(strange, known), "word", "left_anti"), "misspelt")
    capital = F.col("token").rlike("^[A-Z]")
    named = found.where(capital).select("word").distinct().join(strange, "word")
    near = suggestions(named, known, 1).select("word").withColumn("_near", F.lit(True))
    return found.join(strange, "word").join(near, "word", "left").where(~capital | F.col("_near")).select("doc_id", "line_no", "token")


def foreign(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, n, unknown, foreign)``: over a quarter of a document's words unknown."""
    # a document's words are found once and stand once with their number; frequent words are known, so only counts of the others meet documents
    found = staged(tokens(lines).groupBy("doc_id", "word").agg(F.count("*").alias("c")), "doc-words")
    strange = found.join(unknown_words(found, known), "word", "left_semi")
    both = found.select("doc_id", F.col("c").alias("n"), F.lit(0).cast("long").alias("unknown")).unionByName(strange.select("doc_id", F.lit(0).cast("long").alias("n"), F.col("c").alias("unknown")))
    per = both.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("unknown").alias("unknown"))
    return per.withColumn("foreign", F.col("unknown") / F.col("n") > FOREIGN)
