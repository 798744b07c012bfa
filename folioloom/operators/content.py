"""Tokens of web pages, edits of character ranges, and text wrapped to a width; content streams are read by ``lexer``."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACE = re.compile("[ \t\n\x0b\f\r]+")
HTML = r"<!--[\s\S]*?-->|<[^<>]*>|[^<>]+"


def html_tokens(html: Column) -> Column:
    """Comments, tags and what stands between them, in order, without pieces of white space alone."""
    return F.filter(F.regexp_extract_all(html, F.lit(HTML), F.lit(0)), lambda t: t.rlike(r"\S"))


def spliced(text: Column, patches: Column) -> Column:
    """``(text, dropped)``: ``text`` with patches (structs start, end, new: code points from 0) put in, all counted in the text as given, and those left out.

    They go in by their starts, equal starts in the order given. One that begins before the end of the last one put in is
    dropped: the first wins, and what it kept out is told. A null text has no result; null patches are none.
    """
    fields = "struct<start:int,end:int,new:string>"
    given = F.coalesce(patches.cast(f"array<{fields}>"), F.array().cast(f"array<{fields}>"))
    ordered = F.array_sort(F.transform(given, lambda p, k: F.struct(p["start"].alias("start"), k.alias("k"), p["end"].alias("end"), p["new"].alias("new"))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.array().cast(f"array<{fields}>").alias("dropped"))

    def put(a: Column, p: Column) -> Column:
        patch = F.struct(p["start"].alias("start"), p["end"].alias("end"), p["new"].alias("new"))
        before = F.substring(text, a["at"] + 1, p["start"] - a["at"])
        lost = F.struct(a["at"].alias("at"), a["out"].alias("out"), F.concat(a["dropped"], F.array(patch)).alias("dropped"))
        return F.when(p["start"] < a["at"], lost).otherwise(F.struct(p["end"].alias("at"), F.concat(a["out"], F.array(before, p["new"])).alias("out"), a["dropped"].alias("dropped")))

    done = lambda a: F.struct(F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))).alias("text"), a["dropped"].alias("dropped"))
    return F.when(text.isNotNull(), F.aggregate(ordered, empty, put, done))


def merged_ranges(ranges: Column) -> Column:
    """Ranges (structs start, end) as ones that neither overlap nor touch, in order."""
    kind = "struct<start:int,end:int>"
    plain = F.filter(F.transform(ranges, lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"))), lambda r: r["end"] > r["start"])

    def add(a: Column, r: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(r["start"] <= last["end"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(longer))).otherwise(F.concat(a, F.array(r)))

    return F.aggregate(F.array_sort(plain), F.array().cast(f"array<{kind}>"), add)


def erased(text: Column, ranges: Column, mark: str = "█") -> Column:
    """``text`` with each code point of the ranges (structs start, end) under a mark; ranges may overlap and run past the end. They are merged first, so a text is read once."""
    hide = lambda a, r: F.struct(
        r["end"].alias("at"),
        F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, r["start"] - a["at"]), F.repeat(F.lit(mark), F.greatest(F.least(r["end"], F.length(text)) - r["start"], F.lit(0))))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(merged_ranges(ranges), start, hide, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def _wrapper(width: int):
    def wrap(text: str) -> list[str]:
        out, line, used = [], [], 0
        for word in SPACE.split(text):
            if not word:
                continue
            if line and used + 1 + len(word) > width:
                out.append(" ".join(line))
                line, used = [], 0
            used += len(word) + (1 if line else 0)
            line.append(word)
        return [*out, " ".join(line)]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else wrap(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run


def wrapped_lines(text: Column, width: int) -> Column:
    """``text``'s words as lines of at most ``width`` characters; each goes on the line if it fits, and a longer word has its own. A blank text is one empty line.

    A line depends on all before it, so a text is read once, word by word, in an Arrow function; its time is in proportion to the text's length.
    """
    return F.arrow_udf(_wrapper(width), ArrayType(StringType()))(text)


def wrapped(text: Column, width: int) -> Column:
    """``wrapped_lines`` as one text."""
    return F.array_join(wrapped_lines(text, width), "\n")
