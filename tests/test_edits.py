"""Edits, histories, counters and quiet periods over several batches and a restart, fonts and distances, against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from folioloom.operators import distance, fonts, line_edits
from folioloom.streaming import edits, history


def test_changes_fall_to_the_segment_of_the_first_difference(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        sizes = [rng.randint(0, 6) for _ in range(rng.randint(1, 4))]
        old = "".join(rng.choice("abé ") for _ in range(sum(sizes)))
        a, b = sorted(rng.choices(range(len(old) + 1), k=2))
        new = old[:a] + "".join(rng.choice("abé ") for _ in range(rng.randint(0, 4))) + old[b:]
        ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
        rows.append((k, old, new, [(e - s, e) for s, e in zip(sizes, ends)]))
    frame = spark.createDataFrame(rows + [(900, None, "x", [(0, 1)]), (901, "x", None, [(0, 1)])], "k long, old string, new string, g array<struct<start:int,end:int>>")
    got = {r.k: r.parts for r in line_edits.mapped(frame, "old", "new", "g").collect()}
    for k, old, new, segments in rows:
        p = next((i for i, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
        s = next((i for i in range(min(len(old), len(new)) - p) if old[-1 - i] != new[-1 - i]), min(len(old), len(new)) - p)
        target = next((i for i, (x, y) in enumerate(segments) if x <= p < y), len(segments) - 1 if p >= len(old) else 0)
        assert "".join(got[k]) == new if segments else got[k] == []
        for i, (x, y) in enumerate(segments):
            kept = "".join(c for at, c in enumerate(old) if x <= at < y and (at < p or at >= len(old) - s))
            if i != target:
                assert got[k][i] == kept
    assert not [x for k in (900, 901) for x in got[k] or [] if x is not None]


def test_every_edit_is_accounted_for(spark):
    lines = spark.createDataFrame([(1, "one", True), (2, "two", False), (3, "three", True), (4, "four", None)], "id long, text string, editable boolean")
    wanted = [(1, 1, "uno"), (1, 2, "eins"), (2, 1, "due"), (3, 1, "three"), (3, 2, "tre"), (9, 1, "x"), (4, 1, "x"), (1, 3, None)]
    done = line_edits.report(lines, spark.createDataFrame(wanted, "id long, k int, new_text string"), ["id"])
    assert {(r.id, r.k, r.outcome) for r in done.collect()} == {(1, 1, "applied"), (1, 2, "dropped"), (2, 1, "locked"), (3, 1, "same"), (3, 2, "applied"), (9, 1, "unmatched"), (4, 1, "locked"), (1, 3, "same")}
    assert {(r.id, r.text, r.edited) for r in line_edits.applied(lines, done, ["id"]).collect()} == {(1, "uno", True), (2, "two", False), (3, "tre", True), (4, "four", False)}


def ops(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randint(1, 6), k, rng.choice(["edit", "edit", "undo", "redo"]), f"v{k}") for k in range(n)]


def stands(rows):
    """Where each object stands, from the definition: a list of values and how many of them hold."""
    values, held, last = defaultdict(list), defaultdict(int), {}
    for user, seq, op, value in sorted(rows, key=lambda r: r[1]):
        if op == "undo":
            held[user] -= held[user] > 0
        elif op == "redo":
            held[user] += held[user] < len(values[user])
        else:
            values[user] = [*values[user][: held[user]], value]
            held[user] += 1
        last[user] = seq
    return {(u, last[u], values[u][held[u] - 1] if held[u] else None, held[u], held[u] > 0, held[u] < len(values[u])) for u in last}


def test_histories_of_a_log(spark):
    rows = ops(3)
    frame = spark.createDataFrame([*rows, (None, 999, "edit", "x")], "user long, seq long, op string, value string").repartition(4)
    assert {tuple(r) for r in history.replayed(frame, "user", "seq", "op", "value").collect()} == stands(rows)
    assert history.replayed(frame.where("false"), "user", "seq", "op", "value").count() == 0


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_histories_of_a_stream_over_a_restart(spark, tmp_path):
    rows, schema = ops(4), "user long, seq long, op string, value string"
    seen = {}

    def keep(batch, _):
        seen.update({r.user: tuple(r) for r in batch.collect()})

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = history.history(stream, "user", "seq", "op", "value")
        drained(found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())

    for k in range(2):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert set(seen.values()) == stands(rows[:200])
    for k in range(2, 4):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # a new query, whose state comes from the checkpoint
    assert set(seen.values()) == stands(rows)


def test_a_counter_goes_on_over_files(spark, tmp_path):
    schema = "job long, file string, page int"
    out, got = str(tmp_path / "out"), []
    for k, files in enumerate((("b", "a"), ("c",), ("d", "e"))):
        rows = [(job, f, p) for f in files for job in (1, 2) for p in range(1, 4 + job)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        drained(history.numbered(stream, "job", "file", "page").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    got = [tuple(r) for r in spark.read.parquet(out).orderBy("job", "number").collect()]
    want = [(job, f, p) for job in (1, 2) for f in "abcde" for p in range(1, 4 + job)]
    assert [r[:3] for r in got] == want and [r[3] for r in got] == [*range(1, 21), *range(1, 26)]


def test_quiet_periods_with_late_rows_and_snapshots(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[(1, 0), (1, 30), (2, 10)], [(1, 100), (1, 400)], [(1, 1500), (2, 1500)], [(1, 20), (1, 1520)]]  # the last but one moves the watermark past the row at 20
    for k, rows in enumerate(batches):
        spark.createDataFrame([(u, at(s), k) for u, s in rows], "user long, at string, batch int").select("user", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("user long, at timestamp").parquet(str(tmp_path / "in")).withWatermark("at", "5 minutes")
        drained(edits.quiet_periods(stream, "user", "at", "2 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    got = {(r.user, str(r.start)[14:], r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "00:00", 3), (1, "06:40", 1), (2, "00:10", 1)}
    schema = "id long, seq long, value string"
    for k in range(2):  # the second query begins where the first stopped, and finds its last snapshot
        spark.createDataFrame([(1, 10 * k + 1, f"a{k}"), (2 + k, 10 * k + 2, f"b{k}")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        drained(edits.snapshots(stream, "id", "seq", str(tmp_path / "snap"), str(tmp_path / "snap-state")).start())
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "snap" / "1")).collect()} == {(1, 11, "a1"), (2, 2, "b0"), (3, 12, "b1")}


def test_families_and_faces(spark):
    rng = random.Random(8)
    names = ["Inter", "Inter Tight", "inter-tight Display", "Ubu", "Ubuntu Mono", "Noto", "Noto Sans", "Ünicode", "", None]
    styles = ["Regular", "Bold", "Italic", "Bold Oblique", "Book", "Black", ""]
    installed = [(rng.choice(names), rng.choice(styles), k) for k in range(14)]
    wanted = [(k, rng.choice([*names, "Int", "Inter Tight Display Pro", "Ubuntu", "Noto Sans CJK", "Arial"]), rng.random() < 0.5, rng.random() < 0.5) for k in range(80)]
    got = {r.k: (r.face, r.score) for r in fonts.faces(spark.createDataFrame(wanted, "k int, family string, bold boolean, italic boolean"), spark.createDataFrame(installed, "family string, style string, seq int")).collect()}
    key = lambda s: None if s is None else "".join(c for c in s.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")

    def score(style, bold, italic):
        low = style.lower()
        return sum(2 if any(w in low for w in words) == want else -2 for words, want in ((("italic", "oblique"), italic), (("bold", "black", "heavy"), bold))) + (any(w in low for w in ("regular", "book", "roman")) and not bold and not italic)

    for k, family, bold, italic in wanted:
        own, found = key(family), None
        if own:
            known = [key(f) for f, _, _ in installed if f is not None]
            found = own if own in known else next((x for x in known if len(own) >= 4 and x and (x.startswith(own) or own.startswith(x))), None)
        best = max(((score(s, bold, italic), -n, s) for f, s, n in installed if found is not None and key(f) == found), default=None)
        assert got[k] == ((best[2], best[0]) if best else (None, None)), (family, bold, italic)


def test_distances_up_to_a_cap(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé𝒳") for _ in range(rng.randint(0, 7)))
    rows = [(a, a[:1] + word()[:2] + a[2:] if rng.random() < 0.6 else word()) for a in (word() for _ in range(600))] + [("ca", "abc"), ("teh", "the"), (None, "a"), ("a", None)]

    def whole(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    frame = spark.createDataFrame(rows, "a string, b string")
    for cap in (0, 1, 2, 4):
        for r in distance.distances(frame, "a", "b", cap).collect():
            assert r.distance == (None if r.a is None or r.b is None else min(whole(r.a, r.b), cap + 1))
