"""Replayed pages: known answers, odd streams, and random ones against a loop that moves the text matrix glyph by glyph."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.operators import layout, lexer, replay

PAGE = ["doc", "page"]
FONTS = [("A", False, 400.0, 700.0, -200.0, True), ("W", True, 300.0, 700.0, -200.0, False)]
GLYPHS = [("A", c, chr(c), 500.0 + c % 7 * 10) for c in range(32, 127) if chr(c) != "!"] + [("A", 33, None, None), ("W", 0x416, "Ж", 900.0), ("W", 32, " ", None)]


def tables(spark):
    fonts = spark.createDataFrame(FONTS, "font string, two_byte boolean, missing_width double, ascent double, descent double, confident boolean")
    return fonts, spark.createDataFrame(GLYPHS, "font string, code long, glyph string, width double")


def played(spark, streams, objects=()):
    """Events of ``{(doc, stream): content}``; objects are (doc, stream, name, kind, target, matrix)."""
    rows = [(doc, 0, stream, content, "x") for (doc, stream), content in streams.items()]
    frame = spark.createDataFrame(rows, "doc long, page long, stream string, content binary, k string")
    ops = replay.operations(lexer.lexed(frame, "content", *PAGE, "stream"), [*PAGE, "stream"])
    held = spark.createDataFrame([(o[0], 0, *o[1:]) for o in objects], "doc long, page long, stream string, name string, kind string, target string, matrix array<double>")
    return replay.events(ops, held, PAGE)


def runs(spark, streams, objects=()):
    return sorted(replay.runs(played(spark, streams, objects), *tables(spark), PAGE).collect(), key=lambda r: (r.doc, r.seq))


def test_texts(spark):
    width = lambda t: sum(500 + ord(c) % 7 * 10 for c in t) / 1000
    got = runs(
        spark,
        {
            (1, "page"): b"BT /A 10 Tf 5 TL 100 200 Td (ab) Tj (c) Tj T* [(d)-300(e)-100(f)-900( g)] TJ 1 2 (h i) \" (j) ' ET",
            (2, "page"): b"2 0 0 2 1 1 cm BT /A 10 Tf 50 Tz 3 Ts 7 Tr 0 1 -1 0 4 5 Tm (x!) Tj /A -10 Tf (y) Tj ET",
            (3, "page"): b"/W 10 Tf <0416002004160A> Tj /Gone 9 Tf (lost) Tj /A 4 Tf [5] TJ () Tj Tj (one) (two) Tj",
            (4, "page"): b"q /A 8 Tf 1 0 0 rg Q (no font) Tj Q Q /A 8 Tf 0 .5 1 .5 k (a) Tj 1 2 sc (b) Tj .25 scn (c) Tj",
            (5, "page"): b"",
            (6, "page"): None,
            (7, "page"): b"1 2 3 (nothing",
        },
    )
    first = [(r.text, r.op, round(r.x, 6), round(r.y, 6), round(r.advance, 6)) for r in got if r.doc == 1]
    assert first == [
        ("ab", "Tj", 100, 200, round(width("ab") * 10, 6)),
        ("c", "Tj", round(100 + width("ab") * 10, 6), 200, round(width("c") * 10, 6)),
        ("d ef  g", "TJ", 100, 195, round(width("def g") * 10 + 13, 6)),
        ("h i", '"', 100, 190, round(width("h i") * 10 + 3 * 2 + 1, 6)),
        ("j", "'", 100, 185, round(width("j") * 10 + 2, 6)),
    ]
    x, y = [r for r in got if r.doc == 2]
    # up the page: the direction is (0, 1), a rise goes to the left; the code without a glyph has the missing width
    assert (x.text, x.mode, x.dir_x, x.dir_y, x.size, x.x, x.y, round(x.u, 6), round(x.v, 6)) == ("x", 7, 0, 1, 20, 2 * (4 - 3) + 1, 11, 11, -3)
    assert x.advance == pytest.approx(2 * 0.5 * 10 * (width("x") + 0.4))
    assert (y.dir_x, y.dir_y, y.size) == (0, -1, 20) and y.y == pytest.approx(11 + x.advance) and y.advance > 0
    third = [r for r in got if r.doc == 3]
    assert [r.text for r in third] == ["Ж Ж", "", "", "one"] and third[0].advance == pytest.approx(21) and third[1].advance == pytest.approx(-5 / 1000 * 4)
    assert [(r.text, [round(c, 4) for c in r.fill]) for r in got if r.doc == 4] == [("a", [0.5, 0.25, 0]), ("b", [0.5, 0.25, 0]), ("c", [0.25] * 3)]
    assert {r.doc for r in got} == {1, 2, 3, 4}


def test_paths_clips_forms_and_pictures(spark):
    content = b"q 0 0 50 60 re W n 10 10 80 20 re W* n 1 0 0 1 5 5 cm /Fm Do Q 1 1 m 2 2 l 3 0 l W n 4 4 m 9 8 7 6 l s h S /Im Do /No Do"
    form = (1, "page", "Fm", "form", "form", [2.0, 0.0, 0.0, 2.0, 0.0, 0.0])
    got = played(
        spark,
        {
            (1, "page"): content,
            (1, "form"): b"1 2 m 3 4 5 6 7 8 c b* 0 0 1 1 re W f",
            (2, "page"): b"1 0 0 1 1 0 cm 0 0 1 1 re f /Me Do",
            (3, "other"): b"0 0 1 1 re f",
        },
        [form, (1, "page", "Im", "image", None, None), (2, "page", "Me", "form", "page", None), (3, "page", "Im", "image", None, None)],
    )
    rows = sorted(got.collect(), key=lambda r: (r.doc, r.seq is None, r.seq))
    boxes = [(r.kind, r.stream, r.op, r.x0, r.y0, r.x1, r.y1, r.clip, r.clip_complex, r.depth) for r in rows if r.doc == 1 and r.seq is not None]
    assert boxes == [
        ("path", "page>Fm", "b*", 7, 9, 19, 21, [10, 10, 50, 30], False, 0),
        ("path", "page", "s", 4, 4, 7, 6, None, True, 0),
        ("image", "page", "Do", 0, 0, 1, 1, None, True, 0),
    ]
    marks = [(r.kind, r.start) for r in rows if r.doc == 1 and r.seq is None and r.stream == "page"]
    at = content.index
    assert sorted(marks) == sorted([("open", 0), ("clip", 2), ("clip", at(b"10 10")), ("matrix", at(b"1 0 0 1 5")), ("form", at(b"/Fm")), ("close", at(b"Q ")), ("clip", at(b"1 1 m"))])
    # a form that holds itself is drawn eight times more, one step further each time
    assert [r.x0 for r in rows if r.doc == 2 and r.kind == "path"] == list(range(1, 10))
    assert not [r for r in rows if r.doc == 3]


def plain(ops):
    """Places of texts, moving the text matrix on by every glyph."""
    mul = lambda a, b: a @ b
    move = lambda x, y: np.array([[1, 0, 0], [0, 1, 0], [x, y, 1]], float)
    wide = {c: (w if w is not None else 400.0) for f, c, _, w in GLYPHS if f == "A"}
    s, stack, tm, tlm, out = {"ctm": np.eye(3), "size": 10.0, "cs": 0.0, "tl": 0.0}, [], np.eye(3), np.eye(3), []
    for name, *n in ops:
        if name == "q":
            stack.append(dict(s))
        elif name == "Q" and stack:
            s = stack.pop()
        elif name == "cm":
            s["ctm"] = mul(np.array([[n[0], n[1], 0], [n[2], n[3], 0], [n[4], n[5], 1]], float), s["ctm"])
        elif name == "Tf":
            s["size"] = n[0]
        elif name == "Tc":
            s["cs"] = n[0]
        elif name in ("Td", "TD", "T*"):
            s["tl"] = -n[1] if name == "TD" else s["tl"]
            tm = tlm = mul(move(*(n or (0, -s["tl"]))), tlm)
        elif name == "Tj":
            at = mul(tm, s["ctm"])
            out.append((n[0], round(at[2, 0], 5), round(at[2, 1], 5)))
            for c in n[0]:
                tm = mul(move(wide[ord(c)] / 1000 * s["size"] + s["cs"], 0), tm)
    return out


def test_random_streams_against_a_plain_loop(spark):
    rng, streams, want = random.Random(5), {}, {}
    for doc in range(40):
        ops = []
        for _ in range(rng.randrange(60)):
            name = rng.choice(("q", "Q", "cm", "Tf", "Tc", "Td", "TD", "T*", "Tj", "Tj", "Tj"))
            few = lambda k: [rng.randrange(-30, 31) / 10 for _ in range(k)]
            ops.append((name, *{"cm": few(6), "Tf": few(1), "Tc": few(1), "Td": few(2), "TD": few(2), "Tj": ["".join(rng.choices("abc xyz", k=rng.randrange(5)))]}.get(name, [])))
        body = ["/A 10 Tf"]
        for name, *n in ops:
            body.append(f"({n[0]}) Tj" if name == "Tj" else " ".join(map(str, n)) + (" /A " if name == "Tf" and rng.random() < 0.5 else " ") + name)
        streams[doc, "page"], want[doc] = "\n".join(body).encode(), plain(ops)
    got = {}
    for r in runs(spark, streams):
        got.setdefault(r.doc, []).append(r)
    for doc, texts in want.items():
        mine = got.get(doc, [])
        assert [r.text for r in mine] == [t for t, _, _ in texts]
        assert np.allclose([(r.x, r.y) for r in mine] or np.empty((0, 2)), [(x, y) for _, x, y in texts] or np.empty((0, 2)), atol=1e-4)


def test_replayed_runs_make_lines(spark):
    stream = b"BT /A 10 Tf 12 TL 72 700 Td (Some) Tj [-400(words)-400(here)] TJ T* (below) Tj 3 Tr (hidden) Tj ET"
    frame = replay.runs(played(spark, {(1, "page"): stream}), *tables(spark), PAGE)
    lines = layout.lines(layout.grouped_runs(frame.withColumn("extra", F.lit(1)), PAGE), PAGE)
    # a gap before a run's first character is the run's own and reads as nothing
    assert [r.text for r in lines.orderBy("line").collect()] == ["Somewords here", "below"]


def test_no_rows(spark):
    assert runs(spark, {(1, "page"): None}) == []
