import random
import re

import numpy as np
from pyspark.sql import functions as F

from folioloom.llm import components, minhash, passages
from folioloom.llm.wordhash import Words, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, n=60):
    """Random texts with exact copies, near copies in groups and chains, short and empty ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = [None, "", "  \n", "One", "one", "one two", "one two three four five", "one two three four five six"]
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([5, 8, 12, 40, 150]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            base = copy if rng.random() < 0.5 else base
            out.append(" ".join(copy))
    return out


def brute(texts_, n):
    sets = []
    for t in texts_:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_components_are_those_of_all_pairs(spark):
    rows = texts()
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("root", F.lit(1))
    for n in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, n).collect()}
        assert [got[i] for i in range(len(rows))] == brute(rows, n)


def test_long_lists_join_by_centres(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT_LIST", 1)
    rows = texts(2, 25)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, 2).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, 2)


def dense_group(seed, length, copies, most):
    """Copies of one text with edits from a small stock: some link to it, some to each other, most of the far ones to nothing."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(length)]
    out = [" ".join(base[: length // 2]), " ".join(base)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randint(1, most)):
            copy[rng.randrange(length)] = f"x{rng.randrange(12)}"
        out.append(" ".join(copy))
        if rng.random() < 0.3:
            copy[rng.randrange(length)] = "y"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def test_groups_of_copies_that_hardly_link_are_those_of_all_pairs(spark, monkeypatch):
    made = []
    real = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *rest: (made.append(pairs.count()), real(pairs, *rest))[1])
    for length, most in ((40, 5), (120, 12)):
        rows = dense_group(length, length, 150, most)
        frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, 2).collect()}
        assert [got[i] for i in range(len(rows))] == brute(rows, 2)
    assert sum(made) < 40 * len(rows)


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "a b c"), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect())
    assert got == [(-1, None, True), (2, 2, True), (3, 2, False), (3, 2, False), (7, 7, True)]
    assert minhash.near_duplicates(frame.where("false")).count() == 0


def test_components_of_chains_by_all_tasks(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (95, 90), (7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    for few in (0, 1000):
        got = dict(map(tuple, components.components(frame, few).collect()))
        assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}


def test_words_and_shingles():
    data = np.frombuffer(b" Ab cd\x0bab  verylongwordbeyondeight  x", np.uint8)
    found = Words(data, np.array([0, 6, 6, len(data)]))
    h = found.hashes()
    assert found.first.tolist() == [0, 2, 2, 5] and h[0] == h[2] and len(set(h.tolist())) == 4
    assert shingles(h, found.first, 3, short=True)[1].tolist() == [0, 1, 1, 2]


def test_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(4)
    bounds = np.array([0, 30, 33, 33, 80])
    grams = rng.integers(0, 40, 80).astype(np.uint64)
    value, at, left, right, doc = passages.compact_windows(grams, bounds, 6, 2)
    got = set(zip(doc.tolist(), at.tolist(), left.tolist(), right.tolist()))
    from folioloom.llm.wordhash import mix

    own = mix(grams ^ mix(np.array([3], np.uint64)))
    bits = np.uint64(len(grams).bit_length())
    key = (own >> bits << bits) | np.arange(80, dtype=np.uint64)
    want = set()
    for d in range(4):
        for c in range(bounds[d], bounds[d + 1]):
            a = b = c
            while a > bounds[d] and key[a - 1] > key[c]:
                a -= 1
            while b + 1 < bounds[d + 1] and key[b + 1] > key[c]:
                b += 1
            if b - a + 1 >= 6:
                want.add((d, c - bounds[d], c - a, b - c))
    assert got == want


def passage_rows(seed=5):
    rng = random.Random(seed)
    fresh = iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    shared, other = new(60), new(51)
    docs = [new(100), new(30) + shared + new(10), shared + new(40), new(5) + other, new(70) + shared[:50], new(20) + [*shared[:30], "x", *shared[30:]] + new(3), other + ["End."], new(200)]
    return [" ".join(d) for d in docs], rng


def test_passages_of_over_fifty_words(spark):
    rows, _ = passage_rows()
    frame = spark.createDataFrame([*enumerate(rows), (50, None), (51, ""), (None, rows[1])], "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id): (r.start_word, r.n_words, r.first_start_word) for r in passages.repeated_passages(frame).collect()}
    assert got[2, 1] == (0, 60, 30) and got[6, 3] == (0, 51, 5)
    assert got[5, 1][0] == 20  # one word more inside
    assert set(got) == {(2, 1), (6, 3), (5, 1)}  # fifty words alone are no passage
    assert passages.repeated_passages(frame.where("false")).count() == 0


def test_passages_are_cut_but_where_they_stand_first(spark):
    rows, _ = passage_rows()
    frame = spark.createDataFrame([(i, t, len(t), 1) for i, t in enumerate(rows)] + [(90, rows[0], 1, 2), (91, None, None, 3)], "doc_id long, text string, n_chars long, line_no int")
    kept = {r.doc_id: r for r in passages.without_repeats(frame).collect()}
    assert kept[1].text == rows[1] and kept[2].text == " ".join(rows[2].split()[60:]) and kept[2].n_chars == len(kept[2].text)
    named = frame.withColumnsRenamed({"line_no": "_id"}).withColumn("_from", frame["n_chars"]).withColumn("_TO", frame["n_chars"])
    again = passages.without_repeats(named)
    assert again.columns == named.columns and {(r.doc_id, r.text, r._id) for r in again.collect()} == {(r.doc_id, r.text, r.line_no) for r in kept.values()}
    assert kept[6].text == "End." and 90 not in kept and kept[91].text is None and kept[4].text == rows[4]


def test_a_passage_after_its_cut_off_copy(spark):
    fresh = iter(range(10**6))
    new = lambda n: [f"v{next(fresh)}" for _ in range(n)]
    docs = []
    for _ in range(12):
        full = new(60)
        docs += [full[:40] + new(30) + full[:5] + new(20) + full + new(10), new(15) + full + new(15)]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id, r.start_word, r.n_words, r.first_start_word) for r in passages.repeated_passages(frame).collect()}
    assert got == {(2 * k + 1, 2 * k, 15, 60, 95) for k in range(12)}


def best_span(a, b, width):
    """Tokens of the longest span of a that has a similarity of 0.8 with a span of b, by trying all, both with equal edges."""
    best = 0
    for x in range(len(a)):
        for y in range(x + max(width, best + 1), len(a) + 1):
            mine = set(a[x:y])
            for p in (k for k, t in enumerate(b) if t == a[x]):
                for q in (k + 1 for k, t in enumerate(b) if t == a[y - 1] and k >= p):
                    common = len(mine & set(b[p:q]))
                    if 5 * common >= 4 * (len(mine) + q - p - common):
                        best = max(best, y - x)
    return best


def test_passages_of_similarities_from_four_fifths():
    rng = random.Random(8)
    fresh = iter(range(1, 10**9))
    new = lambda n: [next(fresh) for _ in range(n)]
    grams = lambda w: [hash(tuple(w[i : i + 5])) % 2**64 for i in range(len(w) - 4)]
    cases = [(51, [(25, 1, 1)]), (52, [(25, 1, 1)]), (53, [(26, 1, 1)]), (60, [(30, 0, 2)])]
    cases += [(n, [(rng.randrange(6, n - 6), rng.randint(0, 2), rng.randint(0, 2)) for _ in range(rng.randint(1, 2))]) for n in (51, 55, 60, 70, 90, 100) for _ in range(8)]
    found = 0
    for n, edits in cases:
        full = new(n)
        copy = list(full)
        for at, less, more in edits:
            copy[at : at + less] = new(more)
        a, b = (grams(new(20) + w + new(20)) for w in (copy, full))
        want = best_span(a, b, 47)
        got = passages.common_passages(*(passages.Prepared(np.array(x, np.uint64)) for x in (a, b)), 47)
        assert max((p[1] for p in got), default=0) == want, (n, edits)
        for start, size, other, m, like in got:
            one, two = set(a[start : start + size]), set(b[other : other + m])
            assert like == len(one & two) / len(one | two) >= 0.8
        found += bool(want)
    assert found > 30


def test_members_meet_beside_a_centre_that_holds_a_part(spark):
    fresh = iter(range(10**6))
    new = lambda n: [f"z{next(fresh)}" for _ in range(n)]
    docs, want = [], set()
    for n, part in [(51, 50)] * 6 + [(60, 50)] * 6:
        full, k = new(n), len(docs)
        docs += [new(30) + full[:part], new(8) + full + new(30), new(60) + full + new(9), new(5) + full]
        want |= {(k + 2, k + 1, 60, n), (k + 3, k + 1, 5, n)}
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id, r.start_word, r.n_words) for r in passages.repeated_passages(frame).collect()}
    assert want <= got <= want | {(k + 3, k + 2, 5, n) for k, n in [(d - 2, n) for d, f, _, n in want if d == f + 1]}
    # what else stands in the table changes nothing
    crowd = new(80)
    more = [(1000 + i, " ".join(new(20) + crowd[: 60 + i % 20] + new(5))) for i in range(60)]
    wide = spark.createDataFrame([*((i, " ".join(d)) for i, d in enumerate(docs)), *more], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id, r.start_word, r.n_words) for r in passages.repeated_passages(wide).collect() if r.doc_id < 1000} == got


def test_spans_of_many_runs_are_those_of_all_pairs():
    rng = random.Random(3)
    for n in (0, 1, 5, 31, 33, 60, 200):
        starts, ends, hits, at = [], [], [], 0
        for _ in range(n):
            at += rng.randint(1, 12)
            size = rng.randint(1, 40)
            starts.append(at)
            ends.append(at + size)
            hits.append(size - rng.randint(0, size // 4))
            at += size
        sums = [sum(hits[:k]) for k in range(n + 1)]
        want = [(x, y) for x in range(n) for y in range(x + 1, n + 1) if ends[y - 1] - starts[x] >= 47 and 5 * (sums[y] - sums[x]) >= 4 * (ends[y - 1] - starts[x])]
        want.sort(key=lambda s: (starts[s[0]] - ends[s[1] - 1], s))
        assert list(passages.spans_by_length(starts, ends, hits, 47)) == want


def test_passages_of_many_runs_in_one_region():
    fresh = iter(range(1, 10**9))
    new = lambda n: [next(fresh) for _ in range(n)]
    prepared = lambda w: passages.Prepared(np.array(w, np.uint64))
    for n in (5, 40, 80, 200):
        a, b = [], []
        for _ in range(n):  # stretches of 49 tokens, with room between that fits no longer passage
            own = new(49)
            a += own + new(12)
            b += own + new(300)
        got = passages.common_passages(prepared(a), prepared(b), 47)
        assert len(got) == n and sum(p[1] for p in got) == 49 * n


def test_members_pair_where_what_they_share_is_dense_round_the_key(spark):
    line, passage = ([f"{kind}{k}" for k in range(n)] for kind, n in (("line", 13), ("passage", 60)))

    def pairs(gap):
        texts = [(d, " ".join([*line, *(f"own{d}_{k}" for k in range(gap)), *passage])) for d in range(12)]
        now = [(d, 1, 2, 3, 0, 13 + gap + 60 - 5) for d in range(12)]
        held = passages.held_tokens(spark.createDataFrame(now, "doc long, key long, at long, other long, low long, high long"), spark.createDataFrame(texts, "doc_id long, text string"))
        return {tuple(r) for r in passages.sharing(held, 47).collect()}

    assert pairs(40) == set()  # a passage far from the common line makes no pairs of it
    assert pairs(2) == {(a, b) for a in range(12) for b in range(a)}


def test_dense_stretches_are_those_of_all_stretches():
    rng = np.random.default_rng(5)
    for _ in range(300):
        width, n = int(rng.integers(3, 12)), int(rng.integers(1, 40))
        place = np.flatnonzero(rng.random(n) < rng.choice([0.5, 0.8, 0.95]))
        own = rng.choice([0, 0, 0, 1, 2, 3], len(place))
        want = np.zeros(len(place), bool)
        for i in range(len(place)):
            for j in range(i, len(place)):
                size = place[j] - place[i] + 1
                if size >= width and 5 * (j - i + 1) >= 4 * size and (own[i : j + 1] & 1).any() and (own[i : j + 1] & 2).any():
                    want[i : j + 1] = True
        assert (passages.dense(place, own, width) == want).all()


def test_members_of_a_key_are_paired_by_what_two_have_in_common(spark, monkeypatch):
    """Lists of rare tokens made a row for each two members and token; common tokens are counted now, also across blocks of members."""
    begins = [a for a in range(0, 41, 4) for _ in range(3)]
    rows = [(1, doc, 1000 - place, place, 3 if place == 45 else 0) for doc, a in enumerate(begins) for place in range(a, a + 50)]
    held = spark.createDataFrame(rows, "key long, doc long, token long, place long, own byte")
    for block in (256, 7):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = [tuple(r) for r in passages.sharing(held, 47).collect()]
        assert sorted(got) == [(x, y) for x in range(33) for y in range(x) if abs(begins[x] - begins[y]) <= 12]  # 38 of 50
    monkeypatch.setattr(passages, "COLUMNS", 16)
    sets = [np.unique(np.random.default_rng(k).integers(0, 90, 60)) for k in range(9)] + [np.zeros(0, np.int64)]
    assert passages.in_common(sets).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets]
