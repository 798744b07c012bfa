"""Document fingerprints by winnowing, with DataFrame functions only.

The units of a text are its words, those of over ``UNIT`` code points in parts of that many, so that texts of any length
and of any writing, with or without spaces, have units of one kind. All runs of ``K`` units are
hashed; of each window of ``WINDOW`` hashes the least is kept, the rightmost of equals, with its position. So two texts that
share ``K + WINDOW - 1`` units in a row share a fingerprint entry. An entry is one number: 40 bits of hash above 24 bits
that fall with the position (modulo 2**24), which makes the least number the rightmost of equal hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Units a hash, and hashes a window (a power of two).
K, WINDOW = 3, 8
UNIT = 4
#: Rows a range of doc_ids, and the most ranges: their bounds are collected, one number each. A row is compared with two times BOUNDS of them.
RANGE_ROWS, MAX_RANGES, BOUNDS = 4096, 32768, 181
_POSITIONS = 2**24 - 1


def units(text: F.Column) -> F.Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), F.lit(0))


def grams(units_: F.Column) -> F.Column:
    """A number for each run of K units; fewer units make one run."""

    def number(hashed: F.Column, at: F.Column) -> F.Column:
        return hashed.bitwiseAND(F.lit(~_POSITIONS)).bitwiseOR(F.lit(_POSITIONS) - at.cast("long").bitwiseAND(F.lit(_POSITIONS)))

    runs = F.transform(F.sequence(F.lit(0), F.size(units_) - K), lambda i: number(F.xxhash64(*(F.get(units_, i + k) for k in range(K))), i))
    whole = F.array(number(F.xxhash64(F.array_join(units_, " ")), F.lit(0)))
    return F.when(F.size(units_) >= K, runs).when(F.size(units_) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def least_of_windows(numbers: F.Column) -> F.Column:
    """The least of each window in order; a shorter text is one window."""
    least, span = numbers, 1
    while span < WINDOW:
        n = F.size(numbers) - 2 * span + 1
        least, span = F.zip_with(F.slice(least, F.lit(1), n), F.slice(least, F.lit(span + 1), n), lambda a, b: F.least(a, b)), 2 * span
    return least


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the column ``out``: the fingerprint's entries in order of position."""
    df = df.withColumn("_units", units(F.col(text))).withColumn("_grams", grams(F.col("_units"))).drop("_units")
    kept = F.when(F.size("_grams") >= WINDOW, F.array_distinct(least_of_windows(F.col("_grams")))).when(F.size("_grams") > 0, F.array(F.array_min("_grams"))).otherwise(F.col("_grams"))
    return df.withColumn(out, kept).drop("_grams")


def hashes(entries: str) -> F.Column:
    return F.transform(entries, lambda x: F.shiftright(x, 24))


def likeness(a: str, b: str) -> F.Column:
    """Jaccard similarity of two fingerprints' hashes; 1 for two empty ones."""
    common, all_ = F.size(F.array_intersect(hashes(a), hashes(b))), F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(all_ == 0, F.lit(1.0)).otherwise(common / all_)


def shown(entries: str) -> F.Column:
    return F.array_join(F.col(entries).cast("array<string>"), " ")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars (code points) and fingerprint (entries in order of position); a null text is empty, with no entries.

    Equal texts and repeated rows have equal fingerprints. Columns of these names in ``docs`` are replaced.
    """
    plain = docs.drop("n_chars", "fingerprint").withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("_text").cast("long"))
    return fingerprinted(plain, "_text", "fingerprint").drop("_text")


def below(bounds: list[int], x: F.Column) -> F.Column:
    """How many of the sorted bounds are less than x: first among every BOUNDS-th one, then among those that follow it."""
    if not bounds:
        return F.lit(0)
    parts = [bounds[k : k + BOUNDS] for k in range(0, len(bounds), BOUNDS)]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    part = F.greatest(F.size(F.filter(longs([p[0] for p in parts]), lambda b: b < x)) - 1, F.lit(0))
    inside = lambda k: k * BOUNDS + F.size(F.filter(F.get(F.array(*map(longs, parts)), k), lambda b: b < x))
    return F.get(F.transform(F.array(part), inside), 0)


def with_next(df: DataFrame, carried: list[str]) -> DataFrame:
    """``df`` with ``next_`` columns of the row with the next smaller doc_id (after the last, of the first).

    Equal doc_ids follow each other by text; null ones come last. doc_ids are dealt out by ranges of about RANGE_ROWS rows,
    and a range also gets the first row of the one below it; ranges' bounds come from a quantile sketch.
    """
    rows = df.select("doc_id").agg(F.count("*").alias("n")).first()["n"]
    parts = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(df.agg(F.percentile_approx("doc_id", shares, 10 * parts)).first()[0] or [])) if shares else []
    number = F.when(F.col("doc_id").isNull(), -1).otherwise(below(bounds, F.col("doc_id")))
    placed = df.withColumn("_range", number).withColumn("_extra", F.lit(0))
    heads = sorted((r["_range"], r["m"]) for r in placed.groupBy("_range").agg(F.max("doc_id").alias("m")).collect())  # a row a range
    if not heads:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    above = {heads[k][0]: heads[(k + 1) % len(heads)][0] for k in range(len(heads))}
    ids = [m for _, m in heads if m is not None]
    first = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if any(m is None for _, m in heads):
        first = first | F.col("doc_id").isNull()
    goes = F.create_map(*(F.lit(x) for pair in above.items() for x in pair))
    extra = df.where(first).withColumn("_range", number).withColumn("_extra", F.lit(1))
    extra = extra.withColumn("_range", goes[F.col("_range")])
    order = W.partitionBy("_range").orderBy("_extra", F.col("doc_id").desc_nulls_last(), "text")
    both = placed.unionByName(extra)
    out = both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried))
    return out.where("_extra = 0").drop("_range", "_extra")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document, by descending doc_id.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``: the edited text has its last
    floor(n_chars / 3) code points replaced by the first as many, or all, of the next document (the last's next is the first;
    a lone document's next is itself). Null texts are empty; two empty fingerprints are alike.
    """
    own = fingerprints(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = with_next(own, ["text", "fingerprint"])
    third = F.floor(F.col("n_chars") / 3)
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third.cast("int")))
    rows = rows.withColumn("near_next", likeness("fingerprint", "next_fingerprint")).withColumn("text", edited).drop("next_text", "next_fingerprint")
    rows = rows.withColumn("edited_sha256", F.sha2("text", 256))
    rows = fingerprinted(rows, "text", "edited")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("fingerprint").alias("fingerprint"),
        shown("edited").alias("edited_fingerprint"),
        likeness("fingerprint", "edited").alias("near_edited"),
        "near_next",
    )
