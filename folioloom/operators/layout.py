"""Lines, styled segments and repeated passes from placed runs of text.

A run is a row ``(<page columns>, seq, stream, text, font, size, fill, mode, dir_x, dir_y, u, v, advance, ascent, descent,
confident)``: u along its writing direction, v across it, seq its place in the page's order, mode its rendering mode (3 and 7
draw nothing), ascent and descent in thousandths of its size. All work is window functions over a page's runs, which are the
largest group; a break compares a run with the one before it, since a page's first blank runs are all that a line ever leaves out.
``whole_lines`` does the same for all runs of a batch at once where only lines are asked for, so runs are no rows behind it.
Lengths and offsets are code points. Runs with a null text, place or size are not drawn. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from .pages_in_order import codes, whole_pages

#: White space; steps of a baseline (points, shares of the size), gaps back and forth, and the gap that reads as a space (shares of the size).
BLANKS = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
BLANK_LETTERS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
BASELINE_STEP, BASELINE_SHARE, BACK, FORTH, WORD_GAP = 1.2, 0.28, 1.5, 2.2, 0.22
DIRECTION_STEP, SIZE_STEP = 0.01, 0.01
#: How far two passes over one text may lie apart (points), and differ in size.
PASS_STEP, PASS_SIZE = 0.6, 0.1
HIDDEN = (3, 7)


def is_blank(text: Column) -> Column:
    return ~text.rlike("(?s)" + BLANKS.replace("[", "[^", 1))


def drawn(runs: DataFrame) -> DataFrame:
    """Runs that show something: with text, and not in a hidden rendering mode."""
    whole = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("advance").isNotNull() & F.col("size").isNotNull()
    return runs.where((F.length("text") > 0) & ~F.coalesce(F.col("mode"), F.lit(0)).isin(*HIDDEN) & whole)


def grouped_runs(runs: DataFrame, page: list[str]) -> DataFrame:
    """Runs with their line and segment (from 1), lead (a space that no run drew, or empty), start of their text in the line, and gap: the width, in thousandths of the size, that the next run's lead stands for.

    A line goes on while stream and direction stay, the baseline moves by at most 1.2 points or 0.28 of the size, and the gap is over -1.5 and under 2.2 sizes.
    A segment goes on while font, size and fill stay. Lines of blank runs alone are left out.
    """
    order = W.partitionBy(*page).orderBy("seq")
    rows = drawn(runs).withColumn("blank", is_blank(F.col("text")))
    rows = rows.withColumn("any", F.max(~F.col("blank")).over(order)).where("any").drop("any")
    before = {c: F.lag(c).over(order) for c in ("stream", "text", "font", "size", "fill", "dir_x", "dir_y", "u", "v", "advance")}
    rows = rows.withColumns({f"p_{c}": e for c, e in before.items()})
    was, now = (lambda c: F.col(f"p_{c}")), F.col
    apart = now("u") - (was("u") + was("advance"))
    along = (F.abs(now("dir_x") - was("dir_x")) < DIRECTION_STEP) & (F.abs(now("dir_y") - was("dir_y")) < DIRECTION_STEP)
    level = F.abs(now("v") - was("v")) <= F.greatest(F.lit(BASELINE_STEP), was("size") * BASELINE_SHARE)
    goes_on = was("u").isNotNull() & was("stream").eqNullSafe(now("stream")) & along & level & (apart > -was("size") * BACK) & (apart < was("size") * FORTH)
    style = was("font").eqNullSafe(now("font")) & (F.abs(now("size") - was("size")) < SIZE_STEP) & was("fill").eqNullSafe(now("fill"))
    rows = rows.withColumns({"new_line": ~F.coalesce(goes_on, F.lit(False)), "apart": apart, "new_style": ~F.coalesce(style, F.lit(False))})
    spaced = ~F.col("new_line") & (F.col("apart") > F.col("size") * WORD_GAP) & ~was("text").rlike("(?s)" + BLANKS + r"\z") & ~F.col("text").rlike(r"\A" + BLANKS)
    rows = rows.withColumns({"lead": F.when(spaced, " ").otherwise(""), "line": F.sum(F.col("new_line").cast("long")).over(order)})
    inside = W.partitionBy(*page, "line").orderBy("seq")
    rows = rows.withColumn("new_segment", F.col("new_line") | F.col("new_style")).withColumns(
        {
            "segment": F.sum(F.col("new_segment").cast("long")).over(inside),
            "start": F.sum(F.length("lead") + F.length("text")).over(inside) - F.length("text"),
            "next_lead": F.coalesce(F.lead("lead").over(inside), F.lit("")),
            "next_new": F.coalesce(F.lead("new_segment").over(inside), F.lit(False)),
            "gap": F.lead(F.when((F.col("lead") == " ") & (F.col("size") > 0), F.col("apart") / F.col("size") * 1000)).over(inside),
            "any": F.max(~F.col("blank")).over(W.partitionBy(*page, "line")),
        }
    )
    return rows.where("any").drop(*(f"p_{c}" for c in before), "any", "apart", "new_line", "new_style")


def _in_order(piece: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_list(F.struct(F.col("seq"), piece.alias("piece"))))["piece"], "")


def lines(grouped: DataFrame, page: list[str]) -> DataFrame:
    """A row for each line of ``grouped_runs``: text, its ends along the writing direction, its box with ascent and descent, mean size, first font, whether it is of one segment and all its fonts can be written."""
    first = F.min_by(F.struct("stream", "font", "fill", "dir_x", "dir_y", "v", "ascent", "descent"), "seq").alias("f")
    end = F.col("u") + F.col("advance")
    rows = grouped.groupBy(*page, "line").agg(
        _in_order(F.concat("lead", "text")).alias("text"),
        F.min("seq").alias("seq"),
        first,
        F.avg("size").alias("size"),
        F.min(F.least("u", end)).alias("u_min"),
        F.max(F.greatest("u", end)).alias("u_max"),
        (F.max("segment") == 1).alias("uniform"),
        F.min(F.coalesce("confident", F.lit(False))).alias("editable"),
        F.count("*").alias("n_runs"),
    )
    return _placed(rows, page)


def _placed(rows: DataFrame, page: list[str], *more: str) -> DataFrame:
    """Ends and boxes of lines from their first run's struct f, mean size, u_min and u_max."""
    at = lambda u: (F.col(u) * F.col("f.dir_x") - F.col("f.v") * F.col("f.dir_y"), F.col(u) * F.col("f.dir_y") + F.col("f.v") * F.col("f.dir_x"))
    (sx, sy), (ex, ey) = at("u_min"), at("u_max")
    rows = rows.withColumns({"start_x": sx, "start_y": sy, "end_x": ex, "end_y": ey})
    rise = [F.col(f"f.{c}") / 1000 * F.col("size") for c in ("descent", "ascent")]
    xs = [F.col(c) - F.col("f.dir_y") * r for c in ("start_x", "end_x") for r in rise]
    ys = [F.col(c) + F.col("f.dir_x") * r for c in ("start_y", "end_y") for r in rise]
    box = {"x0": F.least(*xs), "x1": F.greatest(*xs), "y0": F.least(*ys), "y1": F.greatest(*ys)}
    return rows.withColumns(box).select(*page, "line", "seq", "f.stream", "text", "f.font", "f.fill", "size", "f.dir_x", "f.dir_y", "f.ascent", "start_x", "start_y", "end_x", "end_y", *box, "uniform", "editable", "n_runs", *more)


def lines_with_parts(grouped: DataFrame, page: list[str]) -> DataFrame:
    """``lines`` with parts: their segments in order (structs segment, start, end, u0, u1, text), from one pass over the runs.

    A line's text is that of its segments: the space before a segment is the end of the one before it.
    """
    end = F.col("u") + F.col("advance")
    rows = grouped.groupBy(*page, "line", "segment").agg(
        _in_order(_piece()).alias("text"),
        F.min("start").cast("long").alias("start"),
        F.min_by("u", "seq").alias("u0"),
        F.max_by(end, "seq").alias("u1"),
        F.min_by(F.struct("stream", "font", "fill", "dir_x", "dir_y", "v", "ascent", "descent"), "seq").alias("f"),
        F.min("seq").alias("seq"),
        F.sum("size").alias("sizes"),
        F.min(F.least("u", end)).alias("u_min"),
        F.max(F.greatest("u", end)).alias("u_max"),
        F.min(F.coalesce("confident", F.lit(False))).alias("editable"),
        F.count("*").alias("n_runs"),
    )
    part = F.struct("segment", "start", (F.col("start") + F.length("text")).alias("end"), "u0", "u1", "text")
    rows = rows.groupBy(*page, "line").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.min_by("f", "segment").alias("f"),
        F.min("seq").alias("seq"),
        (F.sum("sizes") / F.sum("n_runs")).alias("size"),
        F.min("u_min").alias("u_min"),
        F.max("u_max").alias("u_max"),
        (F.max("segment") == 1).alias("uniform"),
        F.min("editable").alias("editable"),
        F.sum("n_runs").alias("n_runs"),
    )
    return _placed(rows.withColumn("text", F.array_join(F.col("parts")["text"], "")), page, "parts")


def _texts(pieces: pa.Array, first: np.ndarray) -> pa.Array:
    """Pieces joined from each place of ``first`` to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(pieces)), pa.int32()), pieces), "")


def _line_maker(page: list[str], arrow: pa.Schema):
    """Drawn runs of whole pages, in order, to their lines; the same breaks as in ``grouped_runs``."""
    n_keys, parts = len(page), "parts" in arrow.names

    def lines_of(rows: pa.RecordBatch) -> pa.RecordBatch:
        text = rows["text"]
        left, right = (trim(text, characters=BLANK_LETTERS) for trim in (pc.utf8_ltrim, pc.utf8_rtrim))
        shows = pc.not_equal(left, "").to_numpy(zero_copy_only=False)
        begins, ends = (pc.not_equal(t, text).to_numpy(zero_copy_only=False) for t in (left, right))
        new_page = np.any([np.diff(codes(c), prepend=-2) != 0 for c in rows.columns[:n_keys]], axis=0)
        seq = rows["seq"].to_numpy()
        if np.any((np.diff(seq) <= 0) & ~new_page[1:]):
            raise ValueError("runs of a page are not in order")
        start = np.flatnonzero(new_page)[np.cumsum(new_page) - 1]
        seen = np.cumsum(shows)
        keep = seen - (seen - shows)[start] > 0
        if not keep.all():  # blank runs at a page's beginning
            new_page = np.diff(np.cumsum(new_page)[keep], prepend=0) != 0
            rows, text, shows, begins, ends = rows.filter(pa.array(keep)), text.filter(pa.array(keep)), shows[keep], begins[keep], ends[keep]
        n = rows.num_rows
        if not n:
            return pa.RecordBatch.from_pylist([], schema=arrow)
        real = lambda c: np.asarray(rows[c].cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False), "f8")
        u, v, size, advance, dir_x, dir_y = map(real, ("u", "v", "size", "advance", "dir_x", "dir_y"))
        same = lambda c: np.diff(codes(rows[c]), prepend=-2) == 0
        step = lambda x: np.abs(np.diff(x, prepend=np.nan))
        was = lambda x: np.concatenate([[np.nan], x[:-1]])
        with np.errstate(invalid="ignore"):
            apart, p_size = u - was(u + advance), was(size)
            goes_on = ~new_page & same("stream") & (step(dir_x) < DIRECTION_STEP) & (step(dir_y) < DIRECTION_STEP)
            goes_on &= (step(v) <= np.maximum(BASELINE_STEP, p_size * BASELINE_SHARE)) & (apart > -p_size * BACK) & (apart < p_size * FORTH)
            new_segment = ~(goes_on & same("font") & (step(size) < SIZE_STEP) & same("_fill"))
            spaced = goes_on & (apart > size * WORD_GAP) & ~np.concatenate([[False], ends[:-1]]) & ~begins
        line = np.flatnonzero(~goes_on)
        of = np.cumsum(~goes_on) - 1
        after = np.append(line[1:], n)
        number = np.arange(len(line)) - np.searchsorted(line, np.flatnonzero(new_page))[np.cumsum(new_page)[line] - 1] + 1
        # a space that no run drew belongs to the segment before it
        behind = np.append(spaced[1:] & new_segment[1:], False)
        space = pa.array(["", " "])
        pieces = pc.binary_join_element_wise(space.take(pa.array((spaced & ~new_segment).astype("i1"))), text, space.take(pa.array(behind.astype("i1"))), "")
        told = np.logical_or.reduceat(shows, line)
        end = u + advance
        first = pa.array(line)
        columns = {"line": pa.array(number), "text": _texts(pieces, line), "u_min": pa.array(np.minimum.reduceat(np.minimum(u, end), line)), "u_max": pa.array(np.maximum.reduceat(np.maximum(u, end), line))}
        columns |= {c: rows[c].take(first) for c in (*page, "seq", "stream", "font", "fill", "dir_x", "dir_y", "v", "ascent", "descent")}
        columns |= {"size": pa.array(np.bincount(of, size) / (after - line)), "uniform": pa.array(np.add.reduceat(new_segment.astype("i8"), line) == 1), "n_runs": pa.array(after - line)}
        columns["editable"] = pa.array(np.logical_and.reduceat(rows["confident"].fill_null(False).to_numpy(zero_copy_only=False), line))
        if parts:
            own = np.flatnonzero(new_segment)
            begin = np.searchsorted(own, line)
            long = np.cumsum(spaced + pc.utf8_length(text).to_numpy(zero_copy_only=False).astype("i8"))
            # a line's text begins with its first run, which has no space before it
            origin = np.concatenate([[0], long[line[1:] - 1]])
            at = long[own] - pc.utf8_length(text).to_numpy(zero_copy_only=False).astype("i8")[own] - origin[of[own]]
            texts = _texts(pieces, own)
            stop = at + pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            last = np.append(own[1:], n) - 1
            found = (np.arange(len(own)) - begin[of[own]] + 1, at, stop, u[own], end[last])
            whole = pa.StructArray.from_arrays([*map(pa.array, found), texts], names=["segment", "start", "end", "u0", "u1", "text"])
            columns["parts"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(own)), pa.int32()), whole)
        out = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)
        return out if told.all() else out.filter(pa.array(told))

    return lines_of


def whole_lines(runs: DataFrame, page: list[str], parts: bool = False, in_order: bool = False) -> DataFrame:
    """``lines`` of ``grouped_runs``, or ``lines_with_parts``, from one pass over the runs of each page, all of a batch at once; a page's runs stand in one task.

    in_order: each page's runs already stand together in one task, in order of seq (which is looked after), so they are neither dealt nor sorted.
    """
    rows = drawn(runs)
    fill = F.transform("fill", lambda c: c + 0).cast("string") if isinstance(runs.schema["fill"].dataType, ArrayType) else F.col("fill")
    used = ["seq", "stream", "text", "font", "size", "fill", "dir_x", "dir_y", "u", "v", "advance", "ascent", "descent", "confident"]
    rows = rows.select(*page, *used, fill.alias("_fill"))
    if not in_order:
        # the window deals and sorts; rows that are dealt by page are not shuffled again
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*page).orderBy("seq")))
    schema = StructType([rows.schema[c] for c in page])
    for field in StructType.fromDDL("line long, seq long, text string, u_min double, u_max double, size double, uniform boolean, editable boolean, n_runs long"):
        schema = schema.add(field)
    for c in ("stream", "font", "fill", "dir_x", "dir_y", "v", "ascent", "descent"):
        schema = schema.add(rows.schema[c])
    if parts:
        schema = schema.add(StructType.fromDDL("parts array<struct<segment: bigint, start: bigint, end: bigint, u0: double, u1: double, text: string>>")[0])
    found = rows.mapInArrow(whole_pages(len(page), _line_maker(page, to_arrow_schema(schema))), schema)
    first = F.struct("stream", "font", "fill", "dir_x", "dir_y", "v", "ascent", "descent")
    return _placed(found.withColumn("f", first), page, *(["parts"] if parts else []))


def _piece() -> Column:
    return F.concat(F.when(F.col("new_segment"), "").otherwise(F.col("lead")), F.col("text"), F.when(F.col("next_new"), F.col("next_lead")).otherwise(""))


def segments(grouped: DataFrame, page: list[str]) -> DataFrame:
    """A row for each styled segment of a line: text with its start and end in the line's, places u0 and u1, space_width (median gap that reads as a space; null without one) and whether its last space was drawn by nothing."""
    rows = grouped.groupBy(*page, "line", "segment").agg(
        _in_order(_piece()).alias("text"),
        F.min("start").cast("long").alias("start"),
        F.first("font").alias("font"),
        F.min_by("size", "seq").alias("size"),
        F.first("fill").alias("fill"),
        F.min_by("u", "seq").alias("u0"),
        F.max_by(F.col("u") + F.col("advance"), "seq").alias("u1"),
        F.sort_array(F.collect_list("gap")).alias("gaps"),
        F.max_by(F.col("next_new") & (F.col("next_lead") == " "), "seq").alias("synthetic_space"),
    )
    median = F.get("gaps", F.floor(F.size("gaps") / 2).cast("int"))
    return rows.withColumns({"end": F.col("start") + F.length("text"), "space_width": median}).drop("gaps")


def _pass_finder(n_keys: int):
    """Lines of whole pages, in order within each text, with the line that they repeat; a text's kept lines stand in cells as wide as the tolerance."""

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.stack([codes(c) for c in [*rows.columns[:n_keys], rows["stream"], rows["text"]]])
        _, of, times = np.unique(np.ascontiguousarray(keys.T).view([("", keys.dtype)] * len(keys)).ravel(), return_inverse=True, return_counts=True)
        # a text that its page holds once repeats nothing
        at = np.flatnonzero(times[of] > 1)
        out, cells = np.full(rows.num_rows, -1, np.int64), {}
        several = rows.select(["line", "start_x", "start_y", "x1", "size"]).take(pa.array(at))
        for k, own, line, x, y, right, size in zip(at.tolist(), of[at].tolist(), *(c.to_pylist() for c in several.columns)):
            if None in (x, y, right, size):  # a line without a place repeats nothing
                continue
            cx, cy = int(x // PASS_STEP), int(y // PASS_STEP)
            near = [
                c
                for i in (-1, 0, 1)
                for j in (-1, 0, 1)
                for c in cells.get((own, cx + i, cy + j), ())
                if abs(c[1] - x) < PASS_STEP and abs(c[2] - y) < PASS_STEP and abs(c[3] - right) < PASS_STEP and abs(c[4] - size) < PASS_SIZE
            ]
            if near:
                out[k] = min(near)[0]
            else:
                cells.setdefault((own, cx, cy), []).append((line, x, y, right, size))
        repeats = np.zeros(rows.num_rows, bool)
        repeats[at] = True
        none = ~repeats | (out == -1)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, mask=none)], names=[*rows.schema.names, "pass_of"])

    return found


def passes(found: DataFrame, page: list[str], in_order: bool = False) -> DataFrame:
    """``lines`` with pass_of: the first kept line of the same stream and text that starts and ends within 0.6 points of it and differs by under 0.1 in size; null for a kept line.

    Lines of one page pass a task in order; each whose text its page holds more than once looks in its own and the neighbouring cells of a grid, so no pairs are made.
    in_order: each page's lines already stand together in one task in order, as ``whole_lines`` leaves them.
    """
    names = [*page, *(c for c in found.columns if c not in page)]
    # the window deals and sorts; rows that are dealt by page are not shuffled again
    rows = found.select(*names) if in_order else found.select(*names, F.row_number().over(W.partitionBy(*page).orderBy("line")).alias("_n"))
    return rows.mapInArrow(whole_pages(len(page), _pass_finder(len(page))), StructType([*rows.schema.fields]).add("pass_of", LongType())).drop("_n")


def merged_passes(found: DataFrame, page: list[str]) -> DataFrame:
    """Kept lines only, with overlays: how many later passes each of them takes in."""
    rows = passes(found, page).withColumn("kept", F.coalesce("pass_of", "line"))
    n = rows.groupBy(*page, "kept").agg((F.count("*") - 1).alias("overlays")).withColumnRenamed("kept", "line")
    return rows.where("pass_of is null").drop("pass_of", "kept").join(n, [*page, "line"])


def _box_ranges(parts: pa.Array, dir_x: pa.Array, dir_y: pa.Array, across: pa.Array, box: pa.Array) -> pa.Array:
    """Of each line, ranges of characters whose middles lie in the box; all characters of a batch at once."""
    real = lambda a: np.asarray(a.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False), "f8")
    whole = lambda a: np.asarray(a.fill_null(0).to_numpy(zero_copy_only=False), "i8")
    n_parts = np.asarray(pc.list_value_length(parts).fill_null(0).to_numpy(zero_copy_only=False), "i8")
    flat, n = parts.flatten(), len(parts)
    lo, hi, u0, u1 = whole(flat.field("start")), whole(flat.field("end")), real(flat.field("u0")), real(flat.field("u1"))
    last = np.cumsum(n_parts) - 1
    # places of a line: before, between and behind its characters
    n_places = np.where(n_parts > 0, (hi[np.maximum(last, 0)] if len(hi) else 0) + 1, 0)
    base = np.cumsum(n_places) - n_places
    line = np.repeat(np.arange(n), n_places)
    place = np.arange(len(line))
    of = np.repeat(np.arange(n), n_parts)
    ends = np.maximum.accumulate(base[of] + np.minimum(hi, n_places[of] - 1)) if len(of) else hi
    own = np.searchsorted(ends, place)
    i = place - base[line]
    at = np.where(i <= lo[own], u0[own], u0[own] + (u1[own] - u0[own]) * (i - lo[own]) / np.maximum(hi[own] - lo[own], 1))
    mid = (at[1:] + at[:-1]) / 2
    of = line[:-1]
    dx, dy, v = real(dir_x)[of], real(dir_y)[of], real(across)[of]
    x0, y0, wide, high = (real(box.field(c))[of] for c in ("x", "y", "width", "height"))
    x, y = mid * dx - v * dy, mid * dy + v * dx
    inside = (line[1:] == of) & (x >= x0) & (x <= x0 + wide) & (y >= y0 - 1) & (y <= y0 + high + 1)
    # where it begins to be inside and where it stops take turns; no range goes over the end of a line, whose last place is inside nothing
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype("i1")))
    begin, stop = edges[::2], edges[1::2]
    count = np.bincount(line[begin], minlength=n) if len(begin) else np.zeros(n, "i8")
    ranges = pa.StructArray.from_arrays([pa.array(begin - base[line[begin]], pa.int64()), pa.array(stop - base[line[begin]], pa.int64())], names=["first", "last"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), ranges)


def ranges_in_box(rows: DataFrame, box: Column) -> DataFrame:
    """``rows`` of lines with parts (their segments in order: structs start, end, u0, u1, all characters of one as wide), a row for each range of characters ``first`` to ``last`` (not included) whose middles lie in a box (struct x, y, width, height).

    The line's middle must lie between the box's lower and upper edge; for its characters a point more counts above and below.
    """
    rows = with_box_ranges(rows, box)
    return rows.withColumn("_r", F.explode("ranges")).withColumns({"first": F.col("_r.first"), "last": F.col("_r.last")}).drop("_r", "ranges")


def with_box_ranges(rows: DataFrame, box: Column) -> DataFrame:
    """``rows`` of lines with parts, as for ``ranges_in_box``, whose middle lies in the box's height, with ranges: structs first, last."""
    middle_v = F.col("start_y") + F.col("ascent") / 1000 * F.col("size") / 2
    across = -F.col("start_x") * F.col("dir_y") + F.col("start_y") * F.col("dir_x")
    rows = rows.where(middle_v.between(box["y"], box["y"] + box["height"]))
    places = F.transform("parts", lambda p: F.struct(p["start"].cast("long").alias("start"), p["end"].cast("long").alias("end"), p["u0"].alias("u0"), p["u1"].alias("u1")))
    found = F.arrow_udf(_box_ranges, "array<struct<first:bigint,last:bigint>>")(places, F.col("dir_x"), F.col("dir_y"), across, box)
    return rows.withColumn("ranges", found)


def _cuts(text: pa.Array, start: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """Of each segment what stays and what goes, in order; what overlaps or touches goes as one."""
    ends, out, gone = [0], [], []
    for t, s, f, e in zip(text.to_pylist(), start.to_pylist(), first.to_pylist(), last.to_pylist()):
        at, n, cut = 0, len(t or ""), None
        spans = sorted((min(max(x - s, 0), n), min(max(y - s, 0), n)) for x, y in zip(f, e) if x is not None and y is not None) if f and t and s is not None else ()
        for x, y in spans:
            if y <= x:
                continue
            if cut and x <= cut[1]:
                cut = (cut[0], max(cut[1], y))
                continue
            if cut:
                out += [t[at : cut[0]], t[cut[0] : cut[1]]]
                gone += [False, True]
                at = cut[1]
            cut = (x, y)
        if cut:
            out += [t[at : cut[0]], t[cut[0] : cut[1]]]
            gone += [False, True]
            at = cut[1]
        if t:
            out.append(t[at:])
            gone.append(False)
        ends.append(len(out))
    kept = np.array([bool(o) for o in out], bool)
    below = np.concatenate([[0], np.cumsum(kept)])
    pieces = pa.StructArray.from_arrays([pa.array([o for o in out if o], pa.string()), pa.array(np.array(gone, bool)[kept])], names=["text", "gone"])
    return pa.ListArray.from_arrays(pa.array(below[ends], pa.int32()), pieces)


def redacted(rows: DataFrame, ranges: str, width=lambda text: F.length(text) * 600.0) -> DataFrame:
    """``rows`` of segments (text, start, end) with pieces: structs (text, gap) of what is drawn when the line's ``ranges`` (structs first, last in the line) are taken out.

    What is taken out leaves a gap as wide as it was, in thousandths of the size (``width`` of its text), and no text, so nothing beside it moves; what stays has
    no gap. Ranges may overlap and reach beyond the segment; a segment that none touches is one piece.
    """
    of = lambda c: F.transform(F.coalesce(F.col(ranges), F.array().cast("array<struct<first:bigint,last:bigint>>")), lambda r: r[c].cast("long"))
    cuts = F.arrow_udf(_cuts, "array<struct<text:string,gone:boolean>>")(F.col("text"), F.col("start").cast("long"), of("first"), of("last"))
    piece = lambda p: F.struct(F.when(p["gone"], "").otherwise(p["text"]).alias("text"), F.when(p["gone"], width(p["text"])).otherwise(0.0).alias("gap"))
    rows = rows.withColumn("_cuts", cuts)
    return rows.withColumn("pieces", F.filter(F.transform("_cuts", piece), lambda p: (p["text"] != "") | (p["gap"] > 0))).drop("_cuts")
