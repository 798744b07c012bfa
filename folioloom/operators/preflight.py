"""Findings about documents by a table of rules, counted and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning", "note")


def findings(docs: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """``(key, what, severity, count)`` from rules (what, severity, how often it holds); all rules in one pass over the rows."""
    each = F.array(*(F.struct(F.lit(what).alias("what"), F.lit(severity).alias("severity"), n.cast("long").alias("count")) for what, severity, n in rules))
    return docs.select(key, F.explode(F.filter(each, lambda r: r["count"] > 0)).alias("f")).select(key, "f.what", "f.severity", "f.count")


def totals(found: DataFrame, key: str) -> DataFrame:
    """``(what, severity, count, n_docs)`` over all documents."""
    return found.groupBy("what", "severity").agg(F.sum("count").alias("count"), F.countDistinct(key).alias("n_docs"))


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def html_rules(html: Column) -> list[tuple[str, str, Column]]:
    """Rules for web pages like those for documents that are to be kept: language, title, scripts, frames, forms, pictures without words."""
    has = lambda pattern: html.rlike("(?i)" + pattern).cast("int")
    count = lambda pattern: F.regexp_count(html, F.lit("(?i)" + pattern))
    return [
        ("no language", "warning", 1 - has(r"<html[^>]*\slang=")),
        ("no title", "warning", 1 - has(r"<title>\s*\S")),
        ("script", "error", count(r"<script[\s>]")),
        ("frame", "error", count(r"<i?frame[\s>]")),
        ("form", "note", count(r"<form[\s>]")),
        ("picture without words", "note", count(r"<img\b") - count(r"<img\b[^>]*\salt=")),
    ]
