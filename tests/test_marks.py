"""Shapes, strokes and moves with known answers and odd inputs, and content that replays to the points it was made of."""

import math

from pyspark.sql import functions as F

from folioloom.operators import lexer, marks, replay

P = "array<struct<x: double, y: double>>"

def blue():
    return F.lit(0.0), F.lit(0.5), F.lit(1.0)

def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v

def test_strokes(spark):
    rows = [(1, [], 2.0, False), (2, [(1.0, 2.0)], 2.0, False), (3, [(1.0, 2.0), (3.0, 4.0)], 0.0, False), (4, [(0.0, 0.0), (2.0, 2.0), (4.0, 1.0), (6.0, 0.0)], 1.5, False), (5, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)], 1.0, True), (6, None, 1.0, True)]
    frame = spark.createDataFrame(rows, f"k long, p {P}, w double, c boolean")
    got = {r.k: r.s for r in frame.select("k", marks.stroke(F.col("p"), F.col("w"), blue(), F.col("c"), F.lit("Half")).alias("s")).collect()}
    head = lambda w: f"\nq /Half gs 1 J 1 j {w} w 0 0.5 1 RG "
    assert got[1] == got[3] == "" and got[6] is None
    assert got[2] == head(2) + "1 2 m 1 2 l S Q\n"
    assert got[4] == head(1.5) + "0 0 m 2 2 3 1.5 v 4 1 5 0.5 v 6 0 l S Q\n"
    assert got[5] == head(1) + "0 0 m 2 0 l 2 2 l h S Q\n"

def test_shapes_and_clouds(spark):
    a, b = marks.point(F.lit(0), F.lit(0)), marks.point(F.lit(20), F.lit(0))
    arrow = one(spark, marks.shape_points(F.lit("arrow"), a, b, F.lit(4.0)))
    assert [round(p.x, 6) for p in arrow] == [0, 20, round(20 - 14 * math.cos(math.pi / 7), 6), 20, round(20 - 14 * math.cos(math.pi / 7), 6)]
    assert one(spark, marks.shape_points(F.lit("star"), a, b, F.lit(1.0))) is None
    square = [[(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)], [(0.0, 20.0), (20.0, 20.0), (20.0, 0.0), (0.0, 0.0)], [(1.0, 1.0)], [], [(5.0, 5.0), (5.0, 5.0)]]
    frame = spark.createDataFrame([(k, c) for k, c in enumerate(square)], f"k long, c {P}")
    got = {r.k: r.p for r in frame.select("k", marks.cloud_points(F.col("c"), F.lit(10)).alias("p")).collect()}
    # two bumps a side, outside whichever way the corners go round
    for k in (0, 1):
        assert len(got[k]) == 4 * 2 * 11 and round(min(p.x for p in got[k]), 6) == -5 and round(max(p.y for p in got[k]), 6) == 25
    assert [(p.x, p.y) for p in got[2]] == [(1, 1)] and got[3] == [] and got[4] == []

def test_moves(spark):
    clip = F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0)))
    held = lambda box, dx, dy: one(spark, F.array(*marks.held(clip, tuple(map(F.lit, box)), F.lit(dx), F.lit(dy))))
    assert held((2.0, 2.0, 4.0, 4.0), -5.0, 9.0) == [-2, 6] and held((-5.0, -5.0, 15.0, 15.0), 3.0, -3.0) == [0, 0]
    turned, flat = F.array(*map(F.lit, (0.0, 2.0, -2.0, 0.0, 7.0, 7.0))), F.array(*map(F.lit, (1.0, 2.0, 2.0, 4.0, 0.0, 0.0)))
    assert one(spark, marks.moved(F.lit("x"), turned, F.lit(4.0), F.lit(-6.0))) == "1 0 0 1 -3 -2 cm\nx\n1 0 0 1 3 2 cm\n"
    assert one(spark, marks.moved(F.lit("x"), flat, F.lit(4.0), F.lit(1.0))) == one(spark, marks.moved(F.lit("x"), turned, F.lit(0.0), F.lit(0.0))) == "x"
    image = lambda m, s, gone: one(spark, marks.image_moved(F.lit("Im"), m, F.lit(4.0), F.lit(-6.0), F.lit(s), F.lit(gone)))
    assert image(turned, 0.0, False) == "q 1 0 0 1 -3 -2 cm /Im Do Q" and image(flat, 2.0, False) == "/Im Do" and image(turned, 2.0, True) == ""
    assert one(spark, marks.filled(tuple(map(F.lit, (1.0, 2.0, 0.0, 4.0))), blue())) == ""

def test_content_replays_to_its_box(spark):
    frame = spark.createDataFrame([(1, [(3.0, 4.0), (8.5, 1.25), (5.0, 9.0)])], f"page long, p {P}").withColumn("stream", F.lit("page"))
    frame = frame.withColumn("own", marks.stroke(F.col("p"), F.lit(2.0), blue(), F.lit(True)))
    content = frame.select("page", "stream", F.concat(F.lit("0 2 -2 0 0 0 cm "), marks.moved(F.col("own"), F.array(*map(F.lit, (0.0, 2.0, -2.0, 0.0, 0.0, 0.0))), F.lit(1.0), F.lit(2.0))).alias("content"))
    row = replay.events(replay.operations(lexer.lexed(content, "content", "page", "stream"), ["page", "stream"]), None, ["page"]).where("kind = 'path'").first()
    assert (row.x0, row.y0, row.x1, row.y1, row.width, row.stroke) == (-18 + 1, 6 + 2, -2.5 + 1, 17 + 2, 2, [0, 0.5, 1])
