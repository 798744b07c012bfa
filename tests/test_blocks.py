"""Blocks, ranges, closure, overlap and drawings on random small pages, against plain loops."""

import random
from collections import defaultdict

import pytest

from folioloom.operators import drawings, intervals

BY = ["page"]


def pages(seed):
    rng = random.Random(seed)
    marks, ranges, points = [], [], []
    for page in range(12):
        places = rng.sample(range(200), rng.randint(0, 60))
        marks += [(page, p, rng.choice(["open", "open", "close", "close", "matrix", "clip", "other"])) for p in places]
        points += [(page, p) for p in rng.sample(range(200), 8)]
        for k in range(12):
            a, b = sorted(rng.sample(range(-5, 210), 2))
            ranges.append((page, k, a, b))
        ranges.append((page, 12, 50, 50))
    return marks, ranges, points


def stack_blocks(marks):
    out = defaultdict(list)
    for page in {m[0] for m in marks}:
        open_ = []
        for _, at, op in sorted(m for m in marks if m[0] == page):
            if op == "open":
                open_.append(at)
            elif op == "close" and open_:
                out[page].append((len(open_), open_[-1], at))
                open_.pop()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_and_ranges(spark, seed):
    marks, ranges, points = pages(seed)
    m = spark.createDataFrame(marks, "page long, at long, op string")
    r = spark.createDataFrame(ranges, "page long, id long, start long, end long")
    o = spark.createDataFrame(points, "page long, at long")
    known = stack_blocks(marks)
    got = {(x.page, x.level, x.open, x.close, x.holds_clip) for x in intervals.blocks(m, BY).collect()}
    clip = lambda page, a, b: any(p == page and op == "clip" and a < at < b for p, at, op in marks)
    assert got == {(page, level, a, b, clip(page, a, b)) for page, all_ in known.items() for level, a, b in all_}

    def is_balanced(page, start, end):
        depth = 0
        for _, at, op in sorted(x for x in marks if x[0] == page and start <= x[1] < end):
            depth += (op == "open") - (op == "close")
            if depth < 0 or (op == "matrix" and depth == 0):
                return False
        return depth == 0

    assert {(x.page, x.id, x.balanced) for x in intervals.balanced(r, m, BY).collect()} == {(p, k, is_balanced(p, a, b)) for p, k, a, b in ranges}

    def tightest(page, start, end):
        fits = [(a, b) for _, a, b in known[page] if a < start and b >= end and clip(page, a, b)]
        if not fits or any(p == page and max(fits)[0] < at < max(fits)[1] + 1 and not start <= at < end for p, at in points):
            return (None, None)
        return max(fits)

    assert {(x.page, x.id, x.open, x.close) for x in intervals.enclosing(r, m, o, BY).collect()} == {(p, k, *tightest(p, a, b)) for p, k, a, b in ranges}

    def grown(page, start, end):
        while cut := [(a, b) for _, a, b in known[page] if (start <= a < end) != (start <= b < end)]:
            start, end = min([start, *(a for a, _ in cut)]), max([end, *(b + 1 for a, b in cut if b >= end)])
        return start, end

    assert {(x.page, x.id, x.start, x.end) for x in intervals.closed(r, m, BY).collect()} == {(p, k, *grown(p, a, b)) for p, k, a, b in ranges}
    n = {(x.page, x.id, x.n) for x in intervals.between(r, o, BY, "start", "end", "n").collect()}
    assert n == {(p, k, sum(q == p and a <= at < b for q, at in points)) for p, k, a, b in ranges}
    assert intervals.balanced(r.where("false"), m, BY).count() == 0 and all(x.balanced for x in intervals.balanced(r, m.where("false"), BY).collect())
    assert intervals.closed(r, m.where("false"), BY).count() == len(ranges) and intervals.enclosing(r, m.where("false"), o, BY).where("open is not null").count() == 0


def test_most_overlap_joins_no_inequality(spark):
    rng = random.Random(5)
    span = lambda: sorted(rng.sample(range(-300, 900), 2))
    one, two = ([(p, k, *span()) for p in range(5) for k in range(20)] for _ in range(2))
    two += [(p, 20 + k, 10, 10) for p in range(5) for k in range(2)] + [(0, 30, *two[0][2:])]
    schema = "page long, id long, start long, end long"
    out = intervals.most_overlap(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), BY, cell=50)
    best = lambda p, a, b: max(((min(b, d) - max(a, c), -k) for q, k, c, d in two if q == p and min(b, d) > max(a, c)), default=None)
    want = {(p, k, -x[1] if x else None, x[0] if x else None) for p, k, a, b in one for x in [best(p, a, b)]}
    assert {(x.page, x.id, x.other, x.overlap) for x in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_drawings(spark):
    rng = random.Random(7)
    paths, foreign, marks = [], [], []
    for page in range(6):
        seq = 0
        for k in range(60):
            seq += 1 + (rng.random() < 0.1)
            x, y = rng.randint(0, 40), rng.randint(0, 40)
            big = rng.random() < 0.05
            paths.append((page, seq, rng.choice([1, 1, 1, 2]), k * 10, k * 10 + 5, float(x), float(y), x + (80.0 if big else rng.randint(0, 12) * 1.0), y + (80.0 if big else rng.randint(0, 12) * 1.0)))
        foreign += [(page, k * 10 + 7) for k in rng.sample(range(60), 5)]
        marks += [(page, k * 10 + 6, rng.choice(["open", "close", "matrix", "matrix"])) for k in rng.sample(range(60), 20)]
    area = 10_000.0
    p = spark.createDataFrame(paths, "page long, seq long, depth long, start long, end long, x0 double, y0 double, x1 double, y1 double")
    f, m = spark.createDataFrame(foreign, "page long, at long"), spark.createDataFrame(marks, "page long, at long, op string")
    got = {tuple(r) for r in drawings.drawings(drawings.breaks(p, f, m, BY), BY, area).select("page", "n", "start", "end", "x0", "y0", "x1", "y1", "rank").collect()}
    want = set()
    for page in range(6):
        depth, matrices = 0, []
        for _, at, op in sorted(x for x in marks if x[0] == page):
            depth = max(0, depth + (op == "open") - (op == "close"))
            if op == "matrix":
                matrices.append((at, depth))
        groups, held = [], None
        box = lambda g: (min(x[5] for x in g), min(x[6] for x in g), max(x[7] for x in g), max(x[8] for x in g))
        for path in (x for x in paths if x[0] == page):
            _, seq, own, start, _, x0, y0, x1, y1 = path
            if (x1 - x0) * (y1 - y0) / area > 0.15:
                held = None
                continue
            joins = False
            if held:
                b, last = box(held), held[-1]
                clear = not any(q == page and last[4] <= at < start for q, at in foreign) and not any(last[4] <= at < start and d < own for at, d in matrices)
                joins = last[1] + 1 == seq and last[2] == own and clear and x0 - 6 <= b[2] and b[0] - 6 <= x1 and y0 - 6 <= b[3] and b[1] - 6 <= y1
            if joins:
                held.append(path)
            else:
                held = [path]
                groups.append(held)
        kept = []
        for g in groups:
            b = box(g)
            w, h, least = b[2] - b[0], b[3] - b[1], 4 if len(g) > 1 else 10
            if w >= least and h >= least and w * h / area <= 0.15 and sum((x[7] - x[5]) * (x[8] - x[6]) for x in g) / max(1e-6, w * h) >= 0.2:
                kept.append((-w * h, g[0][3], len(g), g[-1][4], b))
        for rank, (_, start, n, end, b) in enumerate(sorted(kept), 1):
            want.add((page, n, start, end, *b, rank))
    assert got == want and len(want) > 20
    assert drawings.drawings(drawings.breaks(p.where("false"), f, m, BY), BY, area).count() == 0


def test_path_drawings_read_and_deal_line_items_once(spark):
    """Paths, what is drawn between and marks each read all line items, and counts between dealt them anew."""
    from folioloom.plans import block_queries

    plan = block_queries.path_drawings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Union" not in plan
    assert plan.count("Exchange hashpartitioning") <= 4
