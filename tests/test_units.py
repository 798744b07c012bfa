"""Threads, tokens, patches, ciphers and lines against plain Python and published answers."""

import random

from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import comments, content, files, geometry, lexer, ranks, search, spelling
from folioloom.sources import tables


def test_long_chains_orphans_and_circles(spark):
    rows = [(1, k, k - 1 if k else None) for k in range(400)] + [(2, 1, 9), (2, 2, 1), (3, 1, 2), (3, 2, 1), (4, 7, None)]
    frame = spark.createDataFrame(rows, "t long, id long, up long")
    got = {(r.t, r.id): (r.root, r.depth) for r in comments.threads(frame, "t", "id", "up").collect()}
    assert all(got[1, k] == (0, k) for k in range(400))
    assert got[2, 1] == (1, 0) and got[2, 2] == (1, 1) and got[3, 1] == got[3, 2] == (None, None) and got[4, 7] == (7, 0)
    assert comments.threads(frame.where("false"), "t", "id", "up").count() == 0


STREAM = rb"q 1 0 0 -1.5 .5 72. cm % a (comment" + b"\r" + rb"/F#20a#zz 12 Tf (a \) b) Tj [<48 6z5> -3]TJ << /K 1 >> BT1 +4x 5-3 - (a(b)c\(\n\101\0\9" + b"\\\n" + rb"d\\) > { ) BI /W 1 ID \x00EI EIx" + b"\x00 EI Q (open"


def test_tokens_of_streams(spark):
    want = [
        ("operator", b"q"), ("number", b"1"), ("number", b"0"), ("number", b"0"), ("number", b"-1.5"), ("number", b".5"), ("number", b"72."), ("operator", b"cm"), ("name", b"F a#zz"), ("number", b"12"), ("operator", b"Tf"),
        ("string", b"a ) b"), ("operator", b"Tj"), ("open", b"["), ("hex", b"He"), ("number", b"-3"), ("close", b"]"), ("operator", b"TJ"), ("open", b"<<"), ("name", b"K"), ("number", b"1"), ("close", b">>"), ("operator", b"BT1"), ("number", b"+4x"), ("number", b"5-3"), ("operator", b"-"),
        ("string", b"a(b)c(\nA\x009d\\"), ("operator", b"{"), ("operator", b")"), ("image", rb"BI /W 1 ID \x00EI EIx" + b"\x00 EI"), ("operator", b"Q"), ("string", b"open"),
    ]
    rows = [(1, bytearray(STREAM)), (2, None), (3, bytearray()), (4, bytearray(b"<abc")), (5, bytearray(b"(a\\")), (6, bytearray(b"BI")), (7, bytearray(b"(" * 2000 + b"x" + b")" * 2000))]
    frame = spark.createDataFrame(rows, "value int, content binary").withColumnRenamed("value", "k")
    got = lexer.lexed(frame, "content", "k").orderBy("k", "n").collect()
    first = [r for r in got if r.k == 1]
    assert [(r.kind, bytes(r.value)) for r in first] == want and [r.n for r in first] == list(range(len(want)))
    for r in first:
        raw = STREAM[r.start : r.end]
        assert r.kind in ("name", "string", "hex") or raw == bytes(r.value)
    assert [r.number for r in first if r.kind == "number"] == [1, 0, 0, -1.5, 0.5, 72, 12, -3, 1, 4, 5]
    rest = [(r.k, r.kind, bytes(r.value), r.end) for r in got if r.k > 1]
    assert rest == [(4, "hex", b"\xab\xc0", 4), (5, "string", b"a", 3), (6, "image", b"BI", 2), (7, "string", b"(" * 1999 + b"x" + b")" * 1999, 4001)]


def test_first_patch_wins(spark):
    rows = [("abcdefghij", [(0, 5, "ONE"), (3, 7, "TWO")]), ("abcdef", [(3, 3, "z"), (3, 3, "a")]), ("abc", None), (None, [(0, 1, "x")]), ("abc", [(5, 9, "end")])]
    frame = spark.createDataFrame(rows, "text string, p array<struct<start:int,end:int,new:string>>")
    got = [r.s for r in frame.select(content.spliced(F.col("text"), F.col("p")).alias("s")).collect()]
    assert got[0].text == "ONEfghij" and [tuple(d) for d in got[0].dropped] == [(3, 7, "TWO")]
    assert got[1].text == "abczadef" and got[1].dropped == [] and got[2].text == "abc" and got[3] is None and got[4].text == "abcend"


def test_places_and_replacing(spark):
    rows = [("İ the end",), ("aaa The the",), ("a.b A.B axb",), ("xthethe",), (None,), ("",)]
    frame = spark.createDataFrame(rows, "text string")
    at = [r.a for r in frame.select(search.places(F.col("text"), "the").alias("a")).collect()]
    assert at == [[2], [4, 8], [], [1, 4], None, []]
    say = lambda *a, **b: [r.t for r in frame.select(search.replaced(F.col("text"), *a, **b).alias("t")).collect()]
    assert say("the", "$1\\")[:2] == ["İ $1\\ end", "aaa $1\\ $1\\"] and say("a.b", "!")[2] == "! ! axb"
    assert say("the", "THE", only=F.lit(1))[1:4] == ["aaa The THE", "a.b A.B axb", "xtheTHE"]
    assert say("xthe", "x")[3] == "x" and say("xthe", "x", sweeps=1)[3] == "xthe" and say("the", "athea")[3] == "xatheaathea"
    assert say("the", "-", regard_case=True)[1] == "aaa The -"


def test_patches_marks_and_lines(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        text = "".join(rng.choice("ab cdé\n") for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 4)))
        patches = [(a, b, rng.choice(["", "X", "long one"])) for a, b in zip(cuts[::2], cuts[1::2])]
        rng.shuffle(patches)
        rows.append((k, text, patches))
    frame = spark.createDataFrame(rows, "k long, text string, p array<struct<start:int,end:int,new:string>>")
    got = {r.k: r for r in frame.select("k", content.spliced(F.col("text"), F.col("p")).alias("s"), content.erased(F.col("text"), F.col("p"), "#").alias("e"), content.wrapped(F.col("text"), 9).alias("w")).collect()}
    for k, text, patches in rows:
        want = text
        for a, b, new in sorted(patches, reverse=True):
            want = want[:a] + new + want[b:]
        assert got[k].s.text == want and not got[k].s.dropped
        assert got[k].e == "".join("#" if any(a <= i < b for a, b, _ in patches) else c for i, c in enumerate(text))
        lines = []
        for w in text.split():
            if lines and len(lines[-1]) + 1 + len(w) <= 9:
                lines[-1] += " " + w
            else:
                lines.append(w)
        assert got[k].w == "\n".join(lines)


def test_cipher_is_the_published_one(spark):
    key, vector = "2b7e151628aed2a6abf7158809cf4f3c", "000102030405060708090a0b0c0d0e0f"
    plain = "6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51"
    row = spark.range(1).select(F.hex(files.encrypted(F.unhex(F.lit(plain)), F.unhex(F.lit(key)), F.unhex(F.lit(vector)))).alias("c")).first()
    assert row.c.lower()[:96] == vector + "7649abac8119b246cee98e9b12e9197d" + "5086cb9b507219ee95db113a917678b2"


def test_capitals_count_at_the_first_character_only(spark):
    lines = spark.createDataFrame([(1, 0, "Thre Then Thre wrd"), (1, 1, " Thre wrd"), (1, 2, "ABC ab http://x.y/Wrd"), (1, 3, None)], "doc_id long, line_no int, text string")
    got = sorted((r.line_no, r.token) for r in spelling.tokens(lines).collect())
    assert got == [(0, "Thre"), (0, "wrd"), (1, "wrd")]


def test_ranks_of_groups_of_any_size(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(40)]), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "g int, o int, k int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r.place for r in ranks.ranked(frame, ["g"], ["o", "k"], "place").collect()}
        whole = {r.k: r.place for r in ranks.ranked(frame, [], ["o", "k"], "place").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = lambda o: -1 if o is None else o
    for g in (None, 1, 2):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (first(r[1]), r[2]))
        assert [got[k] for _, _, k in own] == list(range(1, len(own) + 1))
    assert [whole[k] for _, _, k in sorted(rows, key=lambda r: (first(r[1]), r[2]))] == list(range(1, 501))
    assert ranks.ranked(frame.where("false"), ["g"], ["o"]).count() == 0


def test_small_helpers(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Apple\n\nb\nit's\n it's \nnäh\nab1\n")
    assert {r.word for r in tables.word_list(spark, str(tmp_path / "words.txt")).collect()} == {"apple", "it's"}
    rows = [(bytearray(b"\xff\xd8\xff\xe0"), bytearray(b"Key"), 123.456), (bytearray(b"\x89PNG"), bytearray(b""), 12.34), (None, None, 1.234)]
    frame = spark.createDataFrame(rows, "c binary, k binary, x double")
    assert [r.j for r in frame.select(tables.is_jpeg(F.col("c")).alias("j")).collect()] == [True, False, False]
    assert [r.m for r in frame.select(text.measured(F.col("x")).alias("m")).collect()] == ["123", "12.3", "1.23"]
    plain = spark.createDataFrame([(bytearray(b"Plaintext"), bytearray(b"Key"))], "c binary, k binary")
    once = files.rc4(plain, "c", "k")
    assert bytes(once.first().c).hex() == "bbf316e8d940af0ad3" and bytes(files.rc4(once, "c", "k").first().c) == b"Plaintext"
    assert [r.c and bytes(r.c) for r in files.rc4(frame, "c", "k").collect()][1:] == [b"\x89PNG", None]
    points = [(0.0, 0.0), (0.1, 0.0), (0.3, 0.0), (0.5, 0.0), (0.61, 0.0), (0.0, 0.0)]
    path = spark.createDataFrame([(points,), ([],)], "p array<struct<x:double,y:double>>")
    thin = [[tuple(p) for p in r.t] for r in path.select(geometry.thinned(F.col("p")).alias("t")).collect()]
    assert thin == [[(0.0, 0.0), (0.3, 0.0), (0.61, 0.0), (0.0, 0.0)], []]
