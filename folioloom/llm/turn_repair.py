"""Repair of conversation structure by weighted finite-state composition.

Three automata meet: the acceptor of a conversation's rows (one symbol each: the role's kind and the row's fault), the transducer
of edits (Keep, Rerole, Delete, Insert, with costs) and the acceptor of the grammar ``(s?(ua)+)?`` over role initials. Their
composition is never built whole: backward from the end, each place needs only the best (cost, labels) of the four grammar states.
Costs count from the least of them and label strings as ranks, so few such vectors exist, and the step from one by a symbol is made once and remembered.

Conversations are dealt by range of (conv_id, turn), so rows pass in order and nothing is gathered by key. What lies whole inside a
task's range is repaired as it passes; conversations that may go on in another range, and long ones, are joined in pieces.

Rows without conv_id belong to no conversation; null turns come first, and rows with one turn stand in order of the MD5 of ``role:text``.
Null role or text counts as one space. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_order, offsets, part
from .shared import small_batches, written

SPACE = " \t\n\x0b\x0c\r"
#: Rows of a conversation that are held in a task at most, rows of a piece of a longer one, and rows of an Arrow batch that is put out.
HELD, PIECE, OUT = 2048, 256, 1000
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
CLEAN, CUT_OFF, BLANK, TWICE = range(4)
#: Grammar states: nothing yet, after s, after u, after a. A state's move by each kind of role, and by what may be put in or made of another.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT, ACCEPTS = (2, 2, 3, 2), (0, 3)
ROLES = (None, None, "user", "assistant")
KINDS = "suax"


def fault(text: str) -> int:
    """Blank, or cut off before a sentence's end, or neither; repeats are seen by whoever holds the earlier rows."""
    end = text.rstrip(SPACE)
    return BLANK if not end else CLEAN if end[-1] in ".!?" else CUT_OFF


def symbol(role: str, kind_of_fault: int) -> str:
    """One character for a row: its role's kind and its fault."""
    return chr(65 + 4 * "suax".find(role[:1] if role[:1] and role[:1] in "sua" else "x") + kind_of_fault)


@lru_cache(maxsize=None)
def _step(vector: tuple, mark: str) -> tuple[tuple, int, tuple]:
    """From the four states' (cost, rank) behind a row to those before it: ``(vector, least cost, choices)``; a choice is (inserts, edit, state behind)."""
    kind, what = divmod(ord(mark) - 65, 4)
    kind, late = KINDS[kind], CUT if what == CUT_OFF else 0
    best = []
    for state in range(4):
        options, at = [], state
        for inserts in range(3):
            edits = [("D", at, DELETE)]
            if what in (CLEAN, CUT_OFF):
                edits.append(("R", NEXT[at], REROLE + late))
                if (at, kind) in MOVES:
                    edits.append(("K", MOVES[at, kind], KEEP + late))
            for label, to, cost in edits:
                options.append((INSERT * inserts + cost + vector[to][0], "I" * inserts + label, vector[to][1], inserts, to))
            at = NEXT[at]
        best.append(min(options))
    ranks = {x: r for r, x in enumerate(sorted({(b[1], b[2]) for b in best}))}
    least = min(b[0] for b in best)
    return tuple((b[0] - least, ranks[b[1], b[2]]) for b in best), least, tuple((b[3], b[1][-1], b[4]) for b in best)


def repaired(marks: str) -> tuple[int, list[tuple[int, str, int]], int]:
    """``(cost, edits, inserts at the end)`` of the cheapest repair, the least in ASCII among equals; an edit is (inserts before, label, state before the inserts)."""
    vector, cost, choices = ((0, 0), (4, 2), (2, 1), (0, 0)), 0, []
    for mark in reversed(marks):
        vector, least, choice = _step(vector, mark)
        cost += least
        choices.append(choice)
    state, edits = 0, []
    for choice in reversed(choices):
        inserts, label, to = choice[state]
        edits.append((inserts, label, state))
        state = to
    return cost + vector[0][0], edits, (0, 2, 1, 0)[state]


def lines(inserts: int, label: str, state: int) -> tuple[list[str], str | None]:
    """Roles put in before a row, and the role that it gets (None: its own or, if deleted, none)."""
    put = []
    for _ in range(inserts):
        state = NEXT[state]
        put.append(ROLES[state])
    return put, ROLES[NEXT[state]] if label == "R" else None


def audit(edits: list, last: int) -> str:
    return "".join("I" * i + label for i, label, _ in edits) + "I" * last


def counts(marks: str) -> tuple[int, int, int, int]:
    """Blank, repeated and cut-off rows, and neighbours whose roles may not follow each other."""
    kinds = [KINDS[(ord(m) - 65) // 4] for m in marks]
    faults = [(ord(m) - 65) % 4 for m in marks]
    return faults.count(BLANK), faults.count(TWICE), faults.count(CUT_OFF), sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` after damage by crc32(``conv_id:turn``) mod 20; a dropped row stays, gone and without role and text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    kind = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    gone = F.col("kind") == 0
    rows = rows.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"), F.explode(F.expr("if(kind = 3, array(0, 1), array(0))")).alias("copy"))
    return rows.drop("copy")


_FINISHED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OPEN = "part int, local long, turn long, role string, text string, d binary, fault int"
_NAMES = [x.split()[0] for x in f"{_FINISHED}, {_OPEN}".split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in f"{_FINISHED}, {_OPEN}".split(", ")]


def _finished(conv: int, held: list[tuple]) -> tuple:
    """The result of a conversation from its rows (turn, role, text, digest, fault), gone ones with role None."""
    rows, seen, marks = [r for r in held if r[1] is not None], set(), []
    for _, role, _, digest, what in rows:
        marks.append(symbol(role, TWICE if what != BLANK and digest in seen else what))
        seen.add(digest)
    marks = "".join(marks)
    cost, edits, last = repaired(marks)
    turns = {r[0] for r in rows if r[0] is not None}
    out = []
    for (_, role, text, _, _), edit in zip(rows, edits):
        put, new = lines(*edit)
        out += [f"{r}:" for r in put]
        if edit[1] != "D":
            out.append(f"{new or role}:{text}")
    state = _end_state(edits, marks)
    out += [f"{r}:" for r in lines(last, "", state)[0]]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return conv, gaps, *counts(marks), cost, audit(edits, last), hashlib.sha256("\n".join(out).encode("utf-8", "surrogatepass")).hexdigest()


def _end_state(edits: list, marks: str) -> int:
    """The grammar's state behind the last row."""
    if not edits:
        return 0
    inserts, label, state = edits[-1]
    for _ in range(inserts):
        state = NEXT[state]
    return state if label == "D" else NEXT[state] if label == "R" else MOVES[state, KINDS[(ord(marks[-1]) - 65) // 4]]


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to finished conversations, and to open rows of the task's first and last ones and of those of more than HELD rows."""
    here, out, conv, held, is_open, local = part(), [], None, [], True, 0
    finished_gap, open_gap = (None,) * 7, (None,) * 8

    def put_open() -> None:
        nonlocal local
        for turn, role, text, digest, what in held:
            out.append((conv, *open_gap, here, local, turn, role, text, digest, what))
            local += role is not None
        held.clear()

    def flush(least: int = 0) -> Iterator[pa.RecordBatch]:
        nonlocal out
        if len(out) > least:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)
            out = []

    for batch in batches:
        for own, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "d"))):
            if own != conv:
                if is_open:
                    put_open()
                elif held:
                    out.append((*_finished(conv, held), *finished_gap))
                    held.clear()
                conv, is_open, local = own, conv is None, 0
            held.append((*row, None if row[1] is None else fault(row[2])))
            if is_open or len(held) > HELD:
                is_open = True
                put_open()
                yield from flush(OUT)
        yield from flush(OUT)
    put_open()
    yield from flush()


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of symbols ``(conv_id, marks)`` in order to a row for each edit and one (pos 0) with the conversation's counts."""
    conv, pieces = None, []

    def out() -> Iterator[pa.RecordBatch]:
        marks = "".join(pieces)
        cost, edits, last = repaired(marks)
        rows = [(conv, 0, "", None, None, *counts(marks), cost, audit(edits, last))]
        for at, edit in enumerate(edits, 1):
            put, new = lines(*edit)
            rows.append((conv, at, edit[1], "\n".join(f"{r}:" for r in put) or None, new, *[None] * 6))
        if last:
            put, _ = lines(last, "", _end_state(edits, marks))
            rows.append((conv, len(edits) + 1, "D", "\n".join(f"{r}:" for r in put), None, *[None] * 6))
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000]), _PLAN_TYPES)], names=_PLAN_NAMES)

    for batch in batches:
        for own, piece in zip(batch.column("conv_id").to_pylist(), batch.column("marks").to_pylist()):
            if own != conv and conv is not None:
                yield from out()
                pieces.clear()
            conv = own
            pieces.append(piece)
    if conv is not None:
        yield from out()


_PLAN = "conv_id long, pos long, label string, put string, new string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN_NAMES = [x.split()[0] for x in _PLAN.split(", ")]
_PLAN_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in _PLAN.split(", ")]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces ``(conv_id, lines)`` in order to one SHA-256 a conversation; pieces are parted by a line break."""
    conv, running, out = None, None, []
    for batch in batches:
        for own, piece in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist()):
            if own == conv:
                running.update(b"\n")
            else:
                if conv is not None:
                    out.append((conv, running.hexdigest()))
                conv, running = own, hashlib.sha256()
            running.update(piece.encode())
    if conv is not None:
        out.append((conv, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["conv_id", "repaired_sha256"])


def joined(rows: DataFrame) -> DataFrame:
    """The results of conversations that span tasks, from open rows ``(conv_id, part, local, turn, role, text, d, fault)``.

    Symbols and lines are put together in pieces of 256 rows; the edits are found over a conversation's symbols, a byte a row, as long as the audit itself.
    """
    there = rows.where("role is not null")
    pos = F.col("local") + F.coalesce("before", F.lit(0)) + 1
    there = there.join(F.broadcast(offsets(there, "conv_id")), ["conv_id", "part"], "left").select("conv_id", pos.alias("pos"), "turn", "role", "text", "d", "fault")
    there = written(there, "open-turns")
    first = there.groupBy("conv_id", "d").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = there.select("conv_id", "pos", "d", "role", "fault").join(first, ["conv_id", "d"], "left")
    kind = F.substring("role", 1, 1)
    index = F.when(kind == "s", 0).when(kind == "u", 1).when(kind == "a", 2).otherwise(3)
    what = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), TWICE).otherwise(F.col("fault"))
    marks = known.select("conv_id", "pos", F.char(65 + 4 * index + what).alias("mark"))
    chunk = F.floor((F.col("pos") - 1) / PIECE).alias("chunk")
    in_line = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    pieces = marks.groupBy("conv_id", chunk).agg(F.array_join(in_line("mark"), "").alias("marks"))
    plan = written(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_planned, _PLAN), "repair-plans")
    edits = plan.where("pos > 0").select("conv_id", "pos", "label", "put", "new")
    own = F.when(F.col("label") != "D", F.concat(F.coalesce("new", "role"), F.lit(":"), "text"))
    done = edits.join(there.select("conv_id", "pos", "role", "text"), ["conv_id", "pos"], "left").select("conv_id", "pos", F.concat_ws("\n", "put", own).alias("line"), (F.col("put").isNotNull() | own.isNotNull()).alias("any")).where("any")
    text = done.groupBy("conv_id", chunk).agg(F.array_join(in_line("line"), "\n").alias("lines"))
    hashes = text.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    turns = there.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = plan.where("pos = 0").drop("pos", "label", "put", "new")
    out = rows.select("conv_id").distinct().join(turns, "conv_id", "left").join(found, "conv_id", "left").join(hashes, "conv_id", "left")
    names = [x.split()[0] for x in _FINISHED.split(", ")]
    default = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256), **{c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}}
    return out.select("conv_id", *(F.coalesce(c, default[c]).alias(c) for c in names[1:]))


def structure(rows: DataFrame) -> DataFrame:
    """The repair of each conversation of ``rows (conv_id, turn, role, text, gone)``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("d")
    ordered = in_order(rows.select("conv_id", "turn", "role", "text", digest), "conv_id", "turn", "d")
    with small_batches(rows.sparkSession):
        passed = written(ordered.mapInArrow(_pass, f"{_FINISHED}, {_OPEN}"), "turns-passed")
        names = [x.split()[0] for x in _FINISHED.split(", ")]
        spanning = written(joined(passed.where("part is not null").select("conv_id", *(x.split()[0] for x in _OPEN.split(", ")))), "turns-joined")
    return passed.where("part is null").select(*names).unionByName(spanning.select(*names))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """``structure`` of ``conversations (conv_id, turn, role, text)`` after their damage."""
    return structure(damaged(conversations))


#: The four grammar states are carried as strings of a cost of six digits and the labels, so that the least string is the cheapest and then first repair.
SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, conv_id || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda d: ord(d)::BIGINT)),
  lambda a, d: list_reduce([xor(a, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind FROM o),
d AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy_ FROM z WHERE kind <> 0),
s AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text), copy_) AS k FROM d),
w AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY k) AS i0 FROM s),
n AS (SELECT c, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i0 IS NOT NULL AND i0 || i NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY c),
v(c, k, v0, v1, v2, v3) AS (SELECT c, n + 1, '000000', '000004II', '000002I', '000000' FROM n
  UNION ALL
  SELECT c, k, least(b0, put(2, 'I', b2), put(4, 'II', b3)), least(b1, put(2, 'I', b2), put(4, 'II', b3)), least(b2, put(2, 'I', b3)), least(b3, put(2, 'I', b2)) FROM (
    SELECT w.c, w.k, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS t,
      least(put(3, 'D', v0), CASE WHEN fault NOT IN ('b', 'd') THEN least(put(2 + t, 'R', v2), CASE i WHEN 's' THEN put(t, 'K', v1) WHEN 'u' THEN put(t, 'K', v2) END) END) AS b0,
      least(put(3, 'D', v1), CASE WHEN fault NOT IN ('b', 'd') THEN least(put(2 + t, 'R', v2), CASE i WHEN 'u' THEN put(t, 'K', v2) END) END) AS b1,
      least(put(3, 'D', v2), CASE WHEN fault NOT IN ('b', 'd') THEN least(put(2 + t, 'R', v3), CASE i WHEN 'a' THEN put(t, 'K', v3) END) END) AS b2,
      least(put(3, 'D', v3), CASE WHEN fault NOT IN ('b', 'd') THEN least(put(2 + t, 'R', v2), CASE i WHEN 'u' THEN put(t, 'K', v2) END) END) AS b3
    FROM v JOIN w ON w.c = v.c AND w.k = v.k - 1)),
a AS (SELECT c, left(v0, 6)::BIGINT AS cost, v0[7:] AS audit FROM v WHERE k = 1),
x AS (SELECT c, audit[j] AS op, j, len(replace(audit[:j], 'I', '')) AS k, len(replace(audit[:j], 'D', '')) AS out_ FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS j FROM a)),
y AS (SELECT x.*, w.role, w.text, bool_or(op = 'K' AND i = 's') OVER (PARTITION BY x.c) AS has_s FROM x LEFT JOIN w ON w.c = x.c AND w.k = x.k AND op <> 'I'),
r AS (SELECT c, string_agg(CASE WHEN op = 'K' THEN role WHEN (out_ + CASE WHEN has_s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS text FROM y WHERE op <> 'D' GROUP BY c)
SELECT q.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT c FROM o) q LEFT JOIN n ON n.c = q.c LEFT JOIN a ON a.c = q.c LEFT JOIN r ON r.c = q.c
"""


def _macro(sql: str) -> str:
    """``put(cost, label, path)`` written out: its cost goes up and the label comes first."""
    import re

    return re.sub(r"put\(([^,()]*), ('[A-Z]+'), (\w+)\)", r"lpad(CAST(left(\3, 6)::INT + \1 AS VARCHAR), 6, '0') || \2 || \3[7:]", sql)


SQL = _macro(SQL)
