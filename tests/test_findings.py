"""What a review found: work that grew faster than its input, and results that differed from SQL on larger tables."""

import time

from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import content


def test_megabytes_in_the_middle_go_to_the_even_decimal(spark):
    rows = spark.createDataFrame([(32_768_000,), (98_304_000,), (1_048_575,), (1_048_576,), (512,)], "n long")
    assert [r.s for r in rows.select(text.size_text(F.col("n")).alias("s")).collect()] == ["31.2 MB", "93.8 MB", "1024 KB", "1.0 MB", "1 KB"]


def test_long_lines_are_wrapped_in_one_pass(spark):
    words = [f"w{k % 1237}é" for k in range(60_000)]
    lines, start = [], time.time()
    for w in words:
        if lines and len(lines[-1]) + 1 + len(w) <= 60:
            lines[-1] += " " + w
        else:
            lines.append(w)
    frame = spark.createDataFrame([(0, " ".join(words)), (1, " \t "), (2, None)], "k int, text string")
    got = {r.k: r.lines for r in frame.select("k", content.wrapped_lines(F.col("text"), 60).alias("lines")).collect()}
    assert got == {0: lines, 1: [""], 2: None}
    shown = {r.k: r.w for r in frame.select("k", content.wrapped(F.col("text"), 60).alias("w")).collect()}
    assert shown == {0: "\n".join(lines), 1: "", 2: None}
    assert time.time() - start < 60


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pages_are_dealt_once_and_lines_meet_no_runs(spark):
    from folioloom.plans import registry

    for name, shuffles in (("line_groups", 1), ("duplicate_passes", 1), ("segment_runs", 1), ("box_ranges", 1), ("box_redactions", 1), ("line_overflow", 1), ("paragraph_groups", 2), ("paragraph_reflow", 3)):
        shown = plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert shown.count("Exchange hashpartitioning") == shuffles and "Join" not in shown, name


def test_ranges_of_many_segments_and_odd_lines(spark):
    from folioloom.operators import layout

    part = "array<struct<start:bigint,end:bigint,u0:double,u1:double>>"
    kind = f"line int, parts {part}, dir_x double, dir_y double, start_x double, start_y double, ascent double, size double"
    many = [(10 * k, 10 * k + 10, 100.0 * k, 100.0 * k + 100) for k in range(2_000)]
    rows = [(0, many, 1.0, 0.0, 0.0, 0.0, 750.0, 10.0), (1, [], 1.0, 0.0, 0.0, 0.0, 750.0, 10.0), (2, None, 1.0, 0.0, 0.0, 0.0, 750.0, 10.0), (3, [(0, 4, None, 40.0)], 1.0, 0.0, 0.0, 0.0, 750.0, 10.0), (4, many[:1], 1.0, 0.0, 0.0, 0.0, 750.0, 10.0)]
    box = F.struct(F.lit(41.0).alias("x"), F.lit(-5.0).alias("y"), F.lit(150_000.0).alias("width"), F.lit(20.0).alias("height"))
    found = sorted((r.line, r.first, r.last) for r in layout.ranges_in_box(spark.createDataFrame(rows, kind), box).collect())
    assert found == [(0, 4, 15_004), (4, 4, 10)]


def test_common_beginnings_of_long_texts(spark):
    from folioloom.operators import line_edits

    rows = [("x" * 70_000 + "a", "x" * 70_000 + "b", 70_001, 70_000), ("é", "é", 1, 1), ("", "a", 0, 0), ("ab", "cd", 2, 0), ("abc", "abd", 1, 1), (None, "a", 1, None)]
    frame = spark.createDataFrame(rows, "a string, b string, most int, want int")
    assert all(r.n == r.want for r in frame.select("want", line_edits.alike(F.col("a"), F.col("b"), F.col("most")).alias("n")).collect())


def test_operations_are_put_together_as_they_are_read(spark):
    from folioloom.operators import lexer, replay

    rows = [(1, b"q /F1 12 Tf /G (a) 3 <62> [(c) -5] TJ BI /W 1 ID x\nEI 7 8"), (2, b""), (3, None), (4, b"1 2 m 3 4 l S")]
    frame = spark.createDataFrame(rows, "page long, content binary").withColumn("stream", F.lit("page"))
    names = ["page", "k", "op", "start", "end", "name", "parts"]
    old = replay.operations(lexer.lexed(frame, "content", "page", "stream"), ["page", "stream"]).select(names).orderBy("page", "k").collect()
    new = replay.operated(frame, "content", "page", "stream").select(names).orderBy("page", "k").collect()
    assert old == new and len(new) == 8 - 1


def test_points_of_marks_are_made_once(spark):
    from folioloom.plans import registry

    shown = plan(registry.QUERIES["mark_boxes"](spark, "/root/testdata/sf0.001"))
    assert shown.count("ArrowEvalPython") == 2 and "Window" not in shown


def test_keys_of_words_are_not_gathered_at_the_driver(spark):
    from folioloom.operators import spelling
    from folioloom.sources.tables import staged

    unknown, known = (staged(spark.createDataFrame([(w,) for w in words], "word string"), "words") for words in (("hoose", "teh"), ("house", "the", "moose")))
    found = spelling.suggestions(unknown, known)
    assert "SortMergeJoin [key" in plan(found) and "Broadcast" not in plan(found)
    assert sorted((r.word, r.suggestion) for r in found.collect()) == [("hoose", "house"), ("hoose", "moose"), ("teh", "the")]


def test_versions_are_dealt_once_and_pages_are_rows_of_no_group(spark):
    from folioloom.operators import compare
    from folioloom.plans import registry

    for name, shuffles in (("page_align", 4), ("line_diff", 4), ("compare_summary", 5)):
        shown = plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
        # both sides of the pairs, for their lines and for the pages that are alike: the second two are the first two again; a fifth is of counts
        assert "FlatMapGroups" not in shown and shown.count("Exchange hashpartitioning") <= shuffles, name
    # a line break is white space to a line's key, a control character is not, for pages and their lines alike
    texts = ["one\ntwo  three\nfour\u001cfive\nsix", "one\ntwo　three\nfour five\nsix", "", "", None, "x", "\n".join(map(str, range(45))), "\n".join(map(str, range(20, 45)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    changes = [tuple(r)[1:] for r in compare.line_changes(docs).where("pair = 0").collect()]
    assert changes == [(0, "changed", 0, 0, 2, "four\u001cfive", "four five")]
    pages = {(r.pair, r.at): (r.mine, r.theirs) for r in compare.page_alignment(docs).collect()}
    assert pages == {(0, 0): (0, 0), (1, 0): (0, None), (1, 1): (None, 0), (3, 0): (0, None), (3, 1): (1, 0), (3, 2): (2, 1)}
    assert {r.pair: (r.added, r.removed, r.changed, r.pages_added, r.pages_removed) for r in compare.change_summary(docs).collect()} == {0: (0, 0, 1, 0, 0), 1: (1, 1, 0, 1, 1), 3: (20, 0, 0, 1, 0)}


def test_texts_pass_behind_their_fonts_glyphs(spark):
    from folioloom.operators import glyphs
    from folioloom.plans import registry

    shown = plan(registry.QUERIES["line_codes"](spark, "/root/testdata/sf0.001"))
    # pieces of texts are not asked for, so rows do not grow with the characters: texts are dealt once, by font and salt
    assert "CoGroup" not in shown and "hashpartitioning(font" in shown and "glyph#" in shown and shown.count("MapInArrow") == 1
    fonts = spark.createDataFrame([("A", False, 100.0, None), ("B", True, 300.0, 50.0)], "font string, two_byte boolean, missing_width double, space_width double")
    table = [("A", 1, "a", 10.0), ("A", 2, "ab", 20.0), ("A", 3, "abc.", None), ("A", 300, "b", 5.0), ("A", 7, "b", 9.0), ("B", 32, " ", 1.0), ("B", 97, "a", 2.0)]
    known = spark.createDataFrame(table, "font string, code long, glyph string, width double")
    rows = [(1, 1, "A", "ababc. b"), (1, 2, "A", "abcb"), (1, 3, "B", " a  a"), (2, 4, "B", " xa x"), (2, 5, "A", None), (2, 6, "C", "a"), (None, 7, "A", "a"), (3, 8, "A", "  "), (3, 9, "A", "ab" * 700_000)]
    texts = spark.createDataFrame(rows, "page long, id long, font string, text string")
    got = {r.id: (r.parts and [(p.value, p.number) for p in r.parts], r.width, r.n_glyphs, r.missing, [tuple(s) for s in r.spans]) for r in glyphs.encoded(texts, fonts, known, ["page"], salts=3).collect()}
    long = got.pop(9)
    assert long[0] == [(b"\x02" * 700_000, None)] and long[1:4] == (14_000_000.0, 700_000, [])
    assert got == {
        1: ([(b"\x02\x03", None), (None, -250.0), (b"\x07", None)], 379.0, 3, [], [("ababc. b", True)]),
        2: (None, None, 2, ["c"], [("ab", True), ("c", False), ("b", True)]),
        3: ([(b"\0 \0a\0 \0 \0a", None)], 7.0, 5, [], [(" a  a", True)]),
        4: (None, None, 3, ["x"], [(" ", True), ("x", False), ("a ", True), ("x", False)]),
        5: ([], 0.0, 0, [], []),
        8: ([(None, -250.0), (None, -250.0)], 500.0, 0, [], [("  ", True)]),
    }


def test_words_are_found_once_and_long_words_in_time(spark):
    from folioloom.operators import spelling

    rows = [(1, 0, "mail me@x.org or @a@b @@ see www.foo.bar/x http://y/z site-one.com 'quoted' don't'' plain @"), (1, 1, "x" * 300_000 + " plain word"), (2, 0, "@" + "y" * 300_000 + " a@b@" + "z" * 300_000 + "@ plain")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, text string")
    start = time.time()
    found = [(r.doc_id, r.line_no, r.word) for r in spelling.tokens(lines).collect()]
    assert found == [*((1, 0, w) for w in ("mail", "see", "quoted", "don't", "plain")), (1, 1, "plain"), (1, 1, "word"), (2, 0, "plain")]
    # a word without an @ was tried from each of its letters
    assert time.time() - start < 60


def test_tokens_of_many_streams_leave_together(spark, monkeypatch):
    import pyarrow as pa

    from folioloom.operators import lexer

    frame = spark.createDataFrame([(1, "x")], "id long, content string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: run)
    streams = [None if k % 3 == 0 else b"" if k % 3 == 1 else b"(a%d) Tj" % k for k in range(30_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30_000), pa.int64()), pa.array(streams, pa.binary())], names=["id", "content"])
    out = list(lexer.lexed(frame, "content", "id")(iter([batch, batch.slice(0, 2)])))
    # each stream's tokens left by themselves before
    assert [b.num_rows for b in out] == [10_000, 10_000]
    got = [(r["id"], r["n"], r["kind"], r["value"]) for b in out for r in b.to_pylist()]
    assert got == [t for k in range(2, 30_000, 3) for t in ((k, 0, "string", b"a%d" % k), (k, 1, "operator", b"Tj"))]
