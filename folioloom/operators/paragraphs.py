"""Paragraphs from lines, how far their lines may run, and text broken anew over the lines it has.

Lines are rows of ``layout.lines``. A page's lines pass a task in order, and a paragraph is open until a line does not go on
with it: what must be remembered is its leading, the left edges of its first two lines and the width of its column, not the page.
Widths are sums of character widths in thousandths of the size; a font may know only some characters, and a text that it
cannot measure has no width. Lines without text, of several styles or not writable are in no paragraph.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from .pages_in_order import codes, whole_pages

#: Steps that are no new line, leadings and edges that count as equal, the narrowest column (ems) and fewest words a line of wrapped text, and slack of a fit.
SAME_LINE, LEADING, EDGE, COLUMN_EMS, LINE_WORDS, SLACK, SHORT = 0.6, 0.18, 1.5, 12, 3, 0.01, 0.02
SIZE_STEP, DIRECTION_STEP, LEADING_MOST = 0.01, 0.001, 3
SPACE = re.compile("[\t-\r \xa0  -     　﻿]+")


class Widths:
    """Widths of characters by font, in thousandths of the size; ``fonts``: font to (width of others or None, {character: width})."""

    def __init__(self, fonts: dict[str, tuple[float | None, dict[str, float]]] | None = None, default: float | None = 600.0) -> None:
        self.fonts, self.default = fonts or {}, (default, {})

    def of(self, font: str | None, text: str, size: float) -> float | None:
        rest, own = self.fonts.get(font, self.default)
        if not own and rest is not None and rest == int(rest):
            return rest * len(text) / 1000 * size  # whole numbers add up to their product
        total = 0.0
        for c in text:
            w = own.get(c, rest)
            if w is None:
                return None
            total += w
        return total / 1000 * size


def words(text: str) -> list[str]:
    return [w for w in SPACE.split(text) if w]


class _Line:
    """``at``: its place among the rows."""

    def __init__(self, at: int, said: list[str], font: str | None, size: float, dir_x: float, dir_y: float, start_x: float, start_y: float, end_x: float, end_y: float, widths: Widths) -> None:
        self.at, self.font, self.size = at, font, size
        self.dir, self.words = (dir_x, dir_y), said
        self.left = start_x * dir_x + start_y * dir_y
        self.right = end_x * dir_x + end_y * dir_y
        self.across = -start_x * dir_y + start_y * dir_x
        own = widths.of(self.font, " ".join(self.words), self.size)
        self.end = self.left + (own if own is not None else self.right - self.left)


class _Paragraph:
    """Lines that go on with one another; ``column`` is the furthest end so far."""

    def __init__(self, first: _Line) -> None:
        self.lines, self.leading, self.column = [first], 0.0, first.end

    def takes(self, line: _Line, widths: Widths) -> bool:
        last, first = self.lines[-1], self.lines[0]
        if last.font != line.font or abs(last.size - line.size) > SIZE_STEP or any(abs(a - b) > DIRECTION_STEP for a, b in zip(last.dir, line.dir)):
            return False
        # the step of a baseline, in the frame of each line
        step = last.across - line.across
        if not SAME_LINE < step <= line.size * LEADING_MOST or (self.leading and abs(step - self.leading) > self.leading * LEADING):
            return False
        edge = self.lines[1].left if len(self.lines) > 1 else line.left
        if abs(line.left - edge) > EDGE or line.left > first.left + EDGE:
            return False
        word, space = widths.of(last.font, line.words[0], last.size), widths.of(last.font, " ", last.size)
        if word is not None and space is not None and last.end + space + word <= max(self.column, line.end) + SLACK:
            return False  # its first word would have fitted on the line before
        self.leading = self.leading or step
        self.lines.append(line)
        self.column = max(self.column, line.end)
        return True

    def is_prose(self) -> bool:
        if len(self.lines) < 2:
            return True
        wide = max(x.right for x in self.lines) - min(x.left for x in self.lines)
        return wide >= self.lines[0].size * COLUMN_EMS and sum(len(x.words) for x in self.lines) / len(self.lines) >= LINE_WORDS

    def limits(self, widths: Widths) -> list[float]:
        first, found = self.lines[0], []
        space = widths.of(first.font, " ", first.size) or 0.0
        for line, after in zip(self.lines, self.lines[1:]):
            word = widths.of(first.font, after.words[0], first.size)
            found.append(None if word is None else max(line.end, line.end + space + word - SHORT))
        known = [x for x in found if x is not None]
        rest = max(known) if known else max(x.end for x in self.lines)
        return [max(rest if x is None else x, line.end) for x, line in zip([*found, None], self.lines)]


def _grouper(n_keys: int, widths: Widths):
    """Lines of whole pages, in order, with their paragraphs."""

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        new_page = np.any([np.diff(codes(c), prepend=-2) != 0 for c in rows.columns[:n_keys]], axis=0).tolist()
        paragraph, place, limit = ([None] * rows.num_rows for _ in range(3))
        open_, n = None, 0

        def close() -> None:
            nonlocal open_, n
            if open_ and open_.is_prose():
                n += 1
                for k, (line, most) in enumerate(zip(open_.lines, open_.limits(widths)), 1):
                    paragraph[line.at], place[line.at], limit[line.at] = n, k, most
            open_ = None

        of = [rows[c].to_pylist() for c in ("editable", "uniform", "text", "font", "size", "dir_x", "dir_y", "start_x", "start_y", "end_x", "end_y")]
        for at, (first, editable, uniform, text, *more) in enumerate(zip(new_page, *of)):
            if first:
                close()
                n = 0
            said = words(text) if editable and uniform and text else None
            if said:
                line = _Line(at, said, *more, widths)
                if not open_ or not open_.takes(line, widths):
                    close()
                    open_ = _Paragraph(line)
        close()
        more = [pa.array(c, t) for c, t in ((paragraph, pa.int64()), (place, pa.int64()), (limit, pa.float64()))]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, "paragraph", "place", "limit"])

    return found


def grouped(lines: DataFrame, page: list[str], widths: Widths = Widths()) -> DataFrame:
    """``lines`` with paragraph (from 1 on each page; null in none), place in it and limit, how far the line may run along its direction.

    Lines of one font, size and direction go on while the baseline steps as before (18 %, three sizes at most), the left edge is that of the second line (1.5 points; the
    first may be indented), and the first word of a line would not have fitted on the line before. Several lines that are narrower than 12 ems or hold under three words each are a list, and in no paragraph.
    A limit is just short of what the next line's first word would have needed; the last line has the widest of the others.
    """
    kept = [*page, "line", "text", "font", "size", "dir_x", "dir_y", "start_x", "start_y", "end_x", "end_y", "uniform", "editable"]
    # the window deals and sorts; rows that are dealt by page are not shuffled again
    rows = lines.select(*kept, F.row_number().over(W.partitionBy(*page).orderBy("line")).alias("_n"))
    schema = StructType([*rows.schema.fields]).add("paragraph", LongType()).add("place", LongType()).add("limit", DoubleType())
    return rows.mapInArrow(whole_pages(len(page), _grouper(len(page), widths)), schema).drop("_n")


def broken(text: str, lines: list[tuple[float, float]], font: str | None, size: float, widths: Widths = Widths()) -> list[str] | None:
    """``text``'s words over lines of (left, limit), each filled as far as it goes and the last with what is left; null if a word cannot be measured, is wider than all of them, or lines give out."""
    space, all_words = widths.of(font, " ", size), words(text)
    spans = [widths.of(font, w, size) for w in all_words]
    if space is None or None in spans or not lines or any(w > max(limit - left for left, limit in lines) + SLACK for w in spans):
        return None
    out, k = [], 0
    for i, (left, limit) in enumerate(lines):
        held, used = [], 0.0
        while k < len(all_words):
            wide = used + space + spans[k] if held else spans[k]
            if held and wide > limit - left + SLACK and i < len(lines) - 1:
                break
            held.append(all_words[k])
            used, k = wide, k + 1
        out.append(" ".join(held))
    return out


def _reflower(n_keys: int, widths: Widths):
    """Lines of whole paragraphs, in order, with what each says then."""

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        new = np.any([np.diff(codes(c), prepend=-2) != 0 for c in rows.columns[:n_keys]], axis=0)
        starts = np.flatnonzero(new).tolist()
        left = [x * dx + y * dy for x, y, dx, dy in zip(*(rows[c].to_pylist() for c in ("start_x", "start_y", "dir_x", "dir_y")))]
        at, out = list(zip(left, rows["limit"].to_pylist())), []
        own = rows.select(["new_text", "font", "size"]).take(pa.array(starts, pa.int64()))
        for start, stop, text, font, size in zip(starts, [*starts[1:], rows.num_rows], *(c.to_pylist() for c in own.columns)):
            said = None if text is None else broken(text, at[start:stop], font, size, widths)
            out += said or [None] * (stop - start)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string())], names=[*rows.schema.names, "new_line"])

    return found


def reflowed(rows: DataFrame, page: list[str], widths: Widths = Widths()) -> DataFrame:
    """Lines of ``grouped`` with new_text (the same for a paragraph's lines) to the same with new_line, what each line says then; null if the text does not fit or cannot be measured."""
    keys = [*page, "paragraph"]
    names = [*keys, *(c for c in rows.columns if c not in keys)]
    ordered = rows.where("paragraph is not null").select(*names, F.row_number().over(W.partitionBy(*keys).orderBy("place")).alias("_n"))
    return ordered.mapInArrow(whole_pages(len(keys), _reflower(len(keys), widths)), StructType([*ordered.schema.fields]).add("new_line", StringType())).drop("_n")


def overflow(line: Column, old: Column, new: Column, page_width: Column) -> Column:
    """How far past the page a level line runs that says ``new`` (its width) in place of ``old``; only what the change put over the edge counts, and a width that is not known is none.

    line: struct end_x, end_y, dir_x, dir_y.
    """
    level = (F.abs(line["dir_x"] - 1) <= 0.01) & (F.abs(line["dir_y"]) <= 0.01)
    end = line["end_x"] * line["dir_x"] + line["end_y"] * line["dir_y"]
    return F.when(level, F.coalesce(F.greatest(F.lit(0.0), end + (new - old) - F.greatest(page_width, end)), F.lit(0.0))).otherwise(0.0)


def text_of(rows: DataFrame, page: list[str]) -> DataFrame:
    """``(<page>, paragraph, text)``: a paragraph's lines, trimmed, joined by single spaces."""
    said = rows.where("paragraph is not null").groupBy(*page, "paragraph").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all"))
    return said.select(*page, "paragraph", F.array_join(F.filter(F.transform("all", lambda x: F.trim(x["text"])), lambda t: t != ""), " ").alias("text"))
