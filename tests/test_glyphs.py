"""Code maps, widths and names with known answers, odd streams, and encoding against a pattern of the longest pieces."""

import random
import re

from pyspark.sql import functions as F

from folioloom.operators import glyphs, replay


def code_map(spark, content, names=None):
    frame = spark.createDataFrame([(1, content, "x"), (2, None, "x"), (3, b"", "x")], "font long, content binary, n string").drop("n")
    rows = glyphs.code_map(glyphs.cmap_ranges(frame, "content", "font"), ["font"], names).collect()
    assert {r.font for r in rows} <= {1}
    return {r.code: r.glyph for r in rows}


def test_sections_ranges_arrays_and_names(spark):
    names = spark.createDataFrame([("eacute", "é"), ("f_i", "fi")], "name string, glyph string")
    content = b"""(not in a section) <01> 1 beginbfchar <01> <0041> <02> /eacute <03> /f_i.alt <04> /unknown (\\005) (\\000B) <06> 7 <07> <00660069> <08> <D83DDE00> <09> <D83D> <0A> <5A> <0B> <> endbfchar
    3 beginbfrange <10> <12> <0061> <13> <14> [<0078> 5 <0079> <007A>] <20> <1F> <0041> <21> <22> <30> <23> <24> <D83DDE00> <25> <26> /name <27> <28> <000100FF> endbfrange
    1 beginbfchar <01> <0042> <2A> <D83D0041> endbfchar <02> <0041>"""
    got = code_map(spark, content, names)
    assert got == {
        1: "B", 2: "é", 3: "fi", 5: "B", 7: "fi", 8: "😀", 9: "�", 10: "Z", 11: "", 16: "a", 17: "b", 18: "c", 19: "x", 20: "y", 21: "z", 33: "0", 34: "1", 35: "😀", 36: "😁", 39: "\x01ÿ", 40: "\x01Ā",
        42: "�A",
    }
    assert code_map(spark, b"beginbfrange <00000000> <7FFFFFFF> <0041>").keys() == set(range(65_536))
    assert code_map(spark, b"beginbfchar <01> <0041> <02>") == {1: "A"} and code_map(spark, b"beginbfrange <01> <02> [<0041>") == {1: "A"}


def test_names_that_say_what_they_are(spark):
    told = {"uni0416": "Ж", "uni0416.sc": "Ж", "uni04160417": "Ж", "u1F600": "😀", "u0041.alt": "A", "A": "A", "A.sc": "A", "uniD800": None, "u110000": None, "u12": None, "eacute": None, ".notdef": None, "": None, None: None}
    frame = spark.createDataFrame([(n,) for n in told], "name string").select("name", glyphs.glyph_text(F.col("name")).alias("said"))
    assert {r.name: r.said for r in frame.collect()} == told


def test_widths(spark):
    rows = [(1, 1, 32, None, [250.0, None, 300.0]), (1, 2, 34, 36, [500.0]), (1, 3, 50, 40, [1.0]), (1, 4, 60, 61, None), (1, 5, 70, None, []), (2, 1, 0, 10**9, [7.0])]
    found = glyphs.code_widths(spark.createDataFrame(rows, "font long, n long, first long, last long, widths array<double>"), ["font"])
    assert {r.code: r.width for r in found.where("font = 1").collect()} == {32: 250, 34: 500, 35: 500, 36: 500}
    assert found.where("font = 2").count() == 65_536


def test_encoding_against_a_pattern_of_longest_pieces(spark):
    rng = random.Random(2)
    known = ["a", "b", "c", "ab", "abc", "abca", "ca", "😀"]
    table = [("L", k + 1, g, None if g == "b" else 100.0 + k) for k, g in enumerate(known)] + [("L", 200, "a", 999.0), ("L", 201, "abcab", 5.0), ("L", 202, None, 5.0), ("L", 203, "", 5.0), ("W", 32, " ", 111.0), ("W", 300, "a", 222.0)]
    fonts = spark.createDataFrame([("L", False, 50.0, 333.0), ("W", True, 60.0, None), ("E", False, 1.0, None)], "font string, two_byte boolean, missing_width double, space_width double")
    texts = [(p, k, rng.choice("LLLWEX"), "".join(rng.choices("aaabbcc d😀", k=rng.randrange(12)))) for p in range(6) for k in range(20)]
    texts += [(7, 1, "L", None), (7, 2, "L", ""), (7, 3, "W", "a a"), (7, 4, "E", "  "), (7, 5, "L", "ab c" * 20_000), (8, 1, None, "a"), (8, 2, "X", "a")]
    frame = spark.createDataFrame([(*t, 0) for t in texts], "page long, id long, font string, text string, extra int").withColumn("code", F.lit(1))
    glyph_table = spark.createDataFrame(table, "font string, code long, glyph string, width double")
    got = {(r.page, r.id): r for r in glyphs.encoded(frame, fonts, glyph_table, ["page"]).collect()}
    code = {("L", g): k + 1 for k, g in enumerate(known)} | {("W", " "): 32, ("W", "a"): 300}
    width = {("L", g): 50.0 if g == "b" else 100.0 + k for k, g in enumerate(known)} | {("W", " "): 111.0, ("W", "a"): 222.0}
    assert got.keys() == {(p, k) for p, k, f, _ in texts if f in ("L", "W", "E")}
    for p, k, font, text in texts:
        if (p, k) not in got:
            continue
        r = got[p, k]
        pieces = re.findall("abca|abc|ab|ca|." if font == "L" else ".", text or "")
        missing = list(dict.fromkeys(x for x in pieces if x != " " and (font, x) not in code))
        assert (r.missing, r.n_glyphs) == (missing, sum((font, x) in code for x in pieces))
        assert "".join(s.text for s in r.spans) == (text or "") and all(a.there != b.there for a, b in zip(r.spans, r.spans[1:]))
        if missing:
            assert r.parts is None and r.width is None
            continue
        gap = {"L": 333.0, "W": None, "E": 250.0}[font]
        assert r.width == sum(width.get((font, x), gap) for x in pieces)
        told = [g for part in r.parts for g in ([-part.number] if part.value is None else list(part.value) if font != "W" else [int.from_bytes(part.value[i : i + 2], "big") for i in range(0, len(part.value), 2)])]
        assert told == [code.get((font, x), gap) for x in pieces]
    assert [(s.text, s.there) for s in got[7, 4].spans] == [("  ", True)]


def test_encoded_text_replays_as_it_was(spark):
    parts = [{"value": b"\x01\x02", "number": None}, {"value": None, "number": -333.0}, {"value": b"\x01", "number": None}]
    row = {"parts": parts, "size": 10.0, "scale": 1.0, "two_byte": False, "missing_width": 0.0, "char_space": 0.0, "word_space": 0.0}
    text, by = replay._set(row, {1: ("a", 500.0), 2: ("b", 600.0)})
    assert text == "ab a" and round(by, 9) == 19.33
