from itertools import product

import pytest
from pyspark.sql import functions as F

from folioloom.functions import text
from folioloom.operators import comments, pages, spelling


def test_ranges(spark):
    cases = {("1-3, 5, 8-", 10): [1, 2, 3, 5, 8, 9, 10], ("-", 3): [1, 2, 3], ("x, 2, 2", 5): [2], ("7-3", 9): [], ("4-99", 5): [4, 5]}
    for (spec, n), want in cases.items():
        assert spark.range(1).select(pages.page_range(F.lit(spec), F.lit(n)).alias("p")).first().p == want


def test_chunks_keep_every_page_once(spark):
    frame = spark.createDataFrame([(1, p) for p in (1, 2, 3, 5, 6, 9)], "f int, p int")
    rows = pages.split_chunks(frame, "f", "p", 2).orderBy("p").collect()
    assert [(r.p, r.run, r.chunk) for r in rows] == [(1, 0, 0), (2, 0, 0), (3, 0, 1), (5, 1, 2), (6, 1, 2), (9, 2, 3)]


def test_numbers_run_on(spark):
    frame = spark.createDataFrame([(f, p) for f in (9, 2, 5) for p in (1, 2)], "f int, p int")
    rows = pages.running_numbers(frame, "f", "p").orderBy("number").collect()
    assert [(r.f, r.p, r.number) for r in rows] == [(2, 1, 1), (2, 2, 2), (5, 1, 3), (5, 2, 4), (9, 1, 5), (9, 2, 6)]


@pytest.mark.parametrize("value, shown", [(1.0, "1"), (-2.5005, "-2.5"), (0.12345, "0.123"), (float("nan"), "0"), (-0.0, "0"), (1e-9, "0"), (123456.5, "123456.5")])
def test_plain_numbers(spark, value, shown):
    assert spark.range(1).select(text.plain_number(F.lit(value)).alias("t")).first().t == shown


def swaps_and_edits(a, b):
    """Optimal string alignment distance, in full."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_suggestions_are_all_words_one_edit_away(spark):
    words = ["".join(w) for n in (2, 3, 4) for w in product("abc", repeat=n)]
    known = spark.createDataFrame([(w,) for w in words[::2]], "word string")
    unknown = words[1::7]
    got = {}
    for r in spelling.suggestions(spark.createDataFrame([(w,) for w in unknown], "word string"), known, 1000).collect():
        got.setdefault(r.word, set()).add(r.suggestion)
    for w in unknown:
        want = {k for k in words[::2] if k != w and swaps_and_edits(w, k) <= 1 and (k[0] == w[0] or k[1] == w[1])}
        assert got.get(w, set()) - {w} == want


def test_run_together(spark):
    known = spark.createDataFrame([("loss",), ("function",), ("value",)], "word string")
    unknown = spark.createDataFrame([("lossfunction",), ("lossfunctionvalue",), ("lossfunctionx",), ("functionfunctionfunctionfunctionfunctionfunction",), ("lossvalue",)], "word string")
    assert {r.word for r in spelling.run_together(unknown, known).collect()} == {"lossfunction", "lossfunctionvalue"}


def test_threads_follow_replies_in_any_order(spark):
    rows = [(1, 3, 2), (1, 2, 1), (1, 1, None), (1, 9, 77), (2, 1, None), (2, 3, 2)]
    got = {(r.t, r.id): (r.root, r.depth) for r in comments.threads(spark.createDataFrame(rows, "t int, id int, up int"), "t", "id", "up").collect()}
    assert got == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 2), (1, 9): (9, 0), (2, 1): (1, 0), (2, 3): (3, 0)}
