"""Lines, segments, passes, paragraphs and rewrapping on small pages with known answers and against plain loops."""

import random

from pyspark.sql import functions as F

from folioloom.operators import layout, paragraphs
from folioloom.operators.paragraphs import Widths

RUN = "page long, seq long, stream string, text string, font string, size double, fill int, mode int, dir_x double, dir_y double, u double, v double, advance double, ascent double, descent double, confident boolean"
PAGE = ["page"]


def run(seq, text, u, v=0.0, size=10.0, font="A", fill=0, mode=0, dir_=(1.0, 0.0), page=1, stream="s", sure=True):
    return (page, seq, stream, text, font, size, fill, mode, *dir_, float(u), float(v), None if text is None else 6.0 * len(text), 700.0, -200.0, sure)


def test_lines_and_segments(spark):
    rows = [
        run(1, "  ", 0), run(2, "Bold", 20, font="B"), run(3, "then", 47), run(4, "plain", 71), run(5, "hidden", 0, mode=3), run(6, " ", 101), run(7, "far", 107), run(8, "column", 200),
        run(9, " ", 0, -14), run(10, "next", 6, -14), run(11, "line", 34, -13), run(12, "up", 0, -60, dir_=(0.0, 1.0), sure=False), run(13, "   ", 0, -90), run(14, None, 0), run(15, "", 0), run(16, "other", 36, -90, stream="t"),
    ]
    frame = spark.createDataFrame(rows, RUN).withColumn("extra", F.lit(1)).withColumn("line", F.lit("x"))
    grouped = layout.grouped_runs(frame, PAGE).cache()
    lines = {r.text: r for r in layout.lines(grouped, PAGE).collect()}
    assert list(sorted(lines)) == sorted(["Bold thenplain far", "column", " next line", "up", "other"])
    first = lines["Bold thenplain far"]
    assert (first.x0, first.x1, first.y0, first.y1, first.uniform, first.n_runs) == (20, 125, -2, 7, False, 5)
    assert lines["up"].editable is False and (lines["up"].x0, lines["up"].x1, lines["up"].y1) == (60 - 7, 60 + 2, 12)
    segments = [(r.text, r.start, r.end, r.font, r.u0, r.u1, r.synthetic_space) for r in layout.segments(grouped, PAGE).orderBy("line", "segment").collect()]
    assert segments[:2] == [("Bold ", 0, 5, "B", 20, 44, True), ("thenplain far", 5, 18, "A", 47, 125, False)]
    widths = {r.text: r.space_width for r in layout.segments(grouped, PAGE).collect()}
    assert round(widths["Bold "]) == 300 and widths["column"] is None and round(widths[" next line"]) == 400
    assert layout.lines(layout.grouped_runs(frame.where("false"), PAGE), PAGE).count() == 0
    grouped.unpersist()


def test_first_of_several_passes_is_kept(spark):
    rng = random.Random(1)
    rows = []
    for page in range(3):
        for line in range(80):
            rows.append((page, line, rng.choice("ab"), rng.choice(["s", "t"]), rng.randint(0, 30) * 0.2, rng.randint(-10, 20) * 0.2, rng.randint(0, 3) * 0.4, rng.choice([10.0, 10.05, 10.2])))
    frame = spark.createDataFrame(rows, "page long, line long, text string, stream string, start_x double, start_y double, x1 double, size double")
    got = {(r.page, r.line): r.pass_of for r in layout.passes(frame, PAGE).collect()}
    kept = []
    for row in rows:
        page, line, text, stream, x, y, right, size = row
        twin = next((k for k in kept if k[0] == page and k[2:4] == (text, stream) and abs(k[4] - x) < 0.6 and abs(k[5] - y) < 0.6 and abs(k[6] - right) < 0.6 and abs(k[7] - size) < 0.1), None)
        assert got[page, line] == (twin[1] if twin else None)
        if not twin:
            kept.append(row)
    merged = layout.merged_passes(frame, PAGE).collect()
    assert len(merged) == len(kept) and sum(r.overlays for r in merged) == len(rows) - len(kept)


def test_ranges_in_a_box(spark):
    grouped = layout.grouped_runs(spark.createDataFrame([run(1, "abcdef", 0), run(2, "ghij", 60)], RUN), PAGE)
    parts = layout.segments(grouped, PAGE).groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("start", "end", "u0", "u1"))).alias("parts"))
    lines = layout.lines(grouped, PAGE).join(parts, ["page", "line"])
    box = lambda x, w, y=0.0, h=10.0: F.struct(*(F.lit(float(v)).alias(c) for c, v in (("x", x), ("width", w), ("y", y), ("height", h))))
    found = lambda b: sorted((r.line, r.first, r.last) for r in layout.ranges_in_box(lines, b).collect())
    assert found(box(8, 14)) == [(1, 1, 4)] and found(box(0, 500)) == [(1, 0, 6), (2, 0, 4)] and found(box(8, 14, y=5.0)) == [] and found(box(36, 10)) == []


def line(n, text, left=0.0, v=None, size=10.0, font="A", right=None, uniform=True):
    end = left + 6.0 * len(text) if right is None else right
    return (1, n, text, font, size, 1.0, 0.0, float(left), -14.0 * n if v is None else v, float(end), -14.0 * n if v is None else v, uniform, True)


LINE = "page long, line long, text string, font string, size double, dir_x double, dir_y double, start_x double, start_y double, end_x double, end_y double, uniform boolean, editable boolean"


def test_paragraphs(spark):
    prose = ["The first line of a paragraph", "goes on with a second one of", "words and ends."]
    rows = [line(1, prose[0], 12), line(2, prose[1]), line(3, prose[2]), line(4, "A fresh paragraph begins after it"), line(5, "and wraps."), line(9, "Heading", font="B"), line(10, "one"), line(11, "two wide"), line(12, "  "), line(13, "mixed", uniform=False)]
    frame = spark.createDataFrame(rows, LINE)
    got = {r.line: (r.paragraph, r.place) for r in paragraphs.grouped(frame, PAGE).collect()}
    assert [got[k][0] for k in (1, 2, 3)] == [1, 1, 1] and got[4][0] == got[5][0] == 2 and got[9] == (3, 1)
    assert got[12] == got[13] == (None, None)
    limits = {r.line: r.limit for r in paragraphs.grouped(frame, PAGE).collect()}
    assert limits[1] == 12 + 29 * 6 + 6 + 4 * 6 - 0.02 and limits[3] == max(limits[1], limits[2])
    names = [line(k, w, v=-14.0 * k) for k, w in enumerate(["Ada", "Bo", "Cy", "Dee"], 1)]
    assert {r.paragraph for r in paragraphs.grouped(spark.createDataFrame(names, LINE), PAGE).collect()} <= {None, 1, 2, 3, 4}
    assert paragraphs.grouped(frame.where("false"), PAGE).count() == 0


def test_a_paragraphs_own_text_wraps_as_it_was(spark):
    rng = random.Random(6)
    rows, k = [], 0
    for _ in range(20):
        words = ["x" * rng.randint(1, 9) for _ in range(rng.randint(8, 60))]
        k += 5
        held = []
        for w in words:
            if held and len(" ".join([*held, w])) > 40:
                k += 1
                rows.append(line(k, " ".join(held)))
                held = []
            held.append(w)
        k += 1
        rows.append(line(k, " ".join(held)))
    found = paragraphs.grouped(spark.createDataFrame(rows, LINE), PAGE).cache()
    text = paragraphs.text_of(found, PAGE).withColumnRenamed("text", "new_text")
    same = paragraphs.reflowed(found.join(text, ["page", "paragraph"]), PAGE).collect()
    assert same and all(r.new_line == r.text for r in same)
    longer = paragraphs.reflowed(found.join(text.withColumn("new_text", F.concat(F.lit("y" * 300 + " "), "new_text")), ["page", "paragraph"]), PAGE).collect()
    assert all(r.new_line is None for r in longer)
    found.unpersist()


def test_broken_text_and_overflow(spark):
    assert paragraphs.broken("aa bb cc dd", [(0.0, 30.0), (6.0, 36.0)], "A", 10.0) == ["aa bb", "cc dd"]
    assert paragraphs.broken("aa bb cc", [(0.0, 30.0), (0.0, 30.0), (0.0, 30.0)], "A", 10.0) == ["aa bb", "cc", ""]
    assert paragraphs.broken("", [(0.0, 30.0)], "A", 10.0) == [""] and paragraphs.broken("toolongword", [(0.0, 30.0)], "A", 10.0) is None
    only = Widths({"A": (None, {"a": 500.0, " ": 250.0})})
    assert paragraphs.broken("aa b", [(0.0, 99.0)], "A", 10.0, only) is None and paragraphs.broken("aa a", [(0.0, 13.0), (0.0, 9.0)], "A", 10.0, only) == ["aa", "a"]
    rows = [(90.0, 1.0, 0.0, 50.0, 70.0), (90.0, 1.0, 0.0, 50.0, 55.0), (120.0, 1.0, 0.0, 50.0, 55.0), (90.0, 0.0, 1.0, 50.0, 99.0), (90.0, 1.0, 0.0, None, 99.0)]
    frame = spark.createDataFrame(rows, "end_x double, dir_x double, dir_y double, old double, new double").withColumn("end_y", F.lit(0.0))
    out = frame.select(paragraphs.overflow(F.struct("end_x", "end_y", "dir_x", "dir_y"), F.col("old"), F.col("new"), F.lit(100.0)).alias("o")).collect()
    assert [r.o for r in out] == [10.0, 0.0, 5.0, 0.0, 0.0]


def test_what_is_taken_out_leaves_its_width(spark):
    rows = [("abcdef", 4, [(5, 7), (6, 8), (0, 1)]), ("abc", 0, None), ("abc", 0, [(0, 99)]), ("abc", 10, [(0, 10), (13, 20)])]
    frame = spark.createDataFrame(rows, "text string, start long, r array<struct<first:bigint,last:bigint>>")
    got = [[tuple(p) for p in r.pieces] for r in layout.redacted(frame, "r").collect()]
    assert got == [[("a", 0.0), ("", 1800.0), ("ef", 0.0)], [("abc", 0.0)], [("", 1800.0)], [("abc", 0.0)]]
