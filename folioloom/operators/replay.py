"""Pages replayed from their content streams: what is shown, drawn and placed where, in the page's space.

A page's streams are read into operations where they stand, and one pass over these follows the graphics state: a stack, a matrix, colours,
a clip, and streams within streams. Points of a path that follow each other are moved at once. All else is columns. Text moves only its own matrix, which starts anew with each line, so the
pass needs no widths: a run's place is its line's matrix and the running sum of what was shown since. Characters and widths come
from a table of glyphs, behind which a font's texts pass; both are dealt with a salt, so a font that all pages use is no hot key.
A page's operations stand in one task, as a page is what has a state; documents and corpora do not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from . import lexer

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: How deep streams may lie in each other, and the gap (in sizes) that reads as a space.
MOST_DEPTH, WORD_GAP = 8, 0.22
#: Events that leave a task at once, or a few more.
MOST_EVENTS = 10_000
#: Parts that the rows of one code of one font are dealt to.
SALTS = 16
ROOT = "page"
EVENT = (
    "seq long, stream string, kind string, op string, start long, end long, name string, depth long, parts array<struct<value: binary, number: double>>, font string, size double, char_space double, "
    "word_space double, scale double, rise double, mode int, fill array<double>, stroke array<double>, width double, ext string, clip array<double>, clip_complex boolean, ctm array<double>, "
    "line_matrix array<double>, line_id long, x0 double, y0 double, x1 double, y1 double"
)


class State(NamedTuple):
    """What q keeps and Q brings back."""

    ctm: Matrix
    clip: tuple[float, ...] | None = None
    clip_complex: bool = False
    fill: tuple[float, ...] = (0.0, 0.0, 0.0)
    stroke: tuple[float, ...] = (0.0, 0.0, 0.0)
    width: float = 1.0
    ext: str | None = None
    font: str | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


def times(a: Matrix, b: Matrix) -> Matrix:
    """First ``a``, then ``b``, of row vectors."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def colour(n: list[float], kinds: tuple[int, ...]) -> tuple[float, ...] | None:
    """Red, green and blue of one number (grey), three, or four (cyan, magenta, yellow, black), of the allowed counts; None if there are too few."""
    k = max((k for k in kinds if k <= len(n)), default=0)
    if not k:
        return None
    return (n[0],) * 3 if k == 1 else tuple(n[:3]) if k == 3 else tuple((1 - c) * (1 - n[3]) for c in n[:3])


#: Operators that set one number of the state: which, and whether the last number counts or the first.
SETTERS = {"Tc": ("char_space", 0), "Tw": ("word_space", 0), "Tz": ("scale", 0), "TL": ("leading", 0), "Ts": ("rise", 0), "w": ("width", -1)}
#: Operators that set a colour: which, and by how many numbers.
COLOURS = {
    "g": ("fill", (1,)), "rg": ("fill", (3,)), "k": ("fill", (4,)), "sc": ("fill", (1, 3, 4)), "scn": ("fill", (1, 3, 4)),
    "G": ("stroke", (1,)), "RG": ("stroke", (3,)), "K": ("stroke", (4,)), "SC": ("stroke", (1, 3, 4)), "SCN": ("stroke", (1, 3, 4)),
}
#: Operators that add points to a path, and the numbers of one such step.
STEPS = {b"m": 2, b"l": 2, b"c": 6, b"v": 4, b"y": 4}
#: From so many numbers on, points are moved by numpy.
MANY = 32
PAINT = frozenset(("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"))
SHOW = frozenset(("Tj", "TJ", "'", '"'))
LINE = frozenset(("BT", "Td", "TD", "Tm", "T*", "'", '"'))
#: All that a page plays.
PLAYED = frozenset(o.encode() for o in (*SETTERS, *COLOURS, *PAINT, *SHOW, *LINE, *"qQmlcvyhW", "cm", "Tf", "Tr", "gs", "re", "W*", "Do"))


class Page:
    """The events of one page: ``streams`` by name as lists of operations, ``objects`` by (stream, name); of ``kinds`` alone, if there are any."""

    def __init__(self, streams: dict[str, list[dict]], objects: dict[tuple[str, str], dict], kinds: Iterable[str] = ()):
        self.streams, self.objects, self.kinds = streams, objects, kinds
        self.seq = self.lines = 0

    def event(self, stream: str, kind: str, op: dict, s: State, depth: int, **more) -> dict | None:
        seen = kind in ("text", "path", "image")
        seq = self.seq if seen else None
        self.seq += seen
        if self.kinds and kind not in self.kinds:
            return None
        row = {"seq": seq, "stream": stream, "kind": kind, "op": op["op"], "start": op["start"], "end": op["end"], "depth": depth, "scale": s.scale / 100, "ctm": list(s.ctm)}
        for c in ("font", "size", "char_space", "word_space", "rise", "mode", "width", "ext", "clip_complex"):
            row[c] = getattr(s, c)
        return row | {"fill": list(s.fill), "stroke": list(s.stroke), "clip": s.clip and list(s.clip)} | more

    def play(self, source: str, stream: str, s: State, depth: int = 0) -> Iterator[dict]:
        """Events of the stream ``source``, called ``stream`` where it stands."""
        stack, matrix = [], IDENTITY
        self.lines += 1
        line = self.lines
        points, path_start, rects, steps, clips = [], None, 0, 0, False
        for op in self.streams.get(source, ()):
            do = op["op"]
            n = op["numbers"] if "numbers" in op else [p["number"] for p in op["parts"] if p["number"] is not None]
            if do is None:
                path_start = op["start"] if path_start is None else path_start
                points += _corners(n, s.ctm)
                steps += op["steps"]
            elif do == "q":
                yield self.event(stream, "open", op | {"start": op["end"] - 1}, s, len(stack))
                stack.append(s)
            elif do == "Q":
                s = stack.pop() if stack else s
                yield self.event(stream, "close", op | {"start": op["end"] - 1}, s, len(stack))
            elif do == "cm":
                s = s._replace(ctm=times(tuple(n[-6:]), s.ctm)) if len(n) >= 6 else s
                yield self.event(stream, "matrix", op, s, len(stack))
            elif do == "Tf":
                s = s._replace(font=op["name"] if op["name"] is not None else s.font, size=n[-1] if n else s.size)
            elif do in SETTERS and n:
                field, at = SETTERS[do]
                s = s._replace(**{field: n[at]})
            elif do == "Tr" and n:
                s = s._replace(mode=int(n[0]))
            elif do in COLOURS:
                field, kinds = COLOURS[do]
                # sc and scn take exactly one, three or four numbers, the others at least their own count
                found = colour(n, kinds) if len(kinds) == 1 or len(n) in kinds else None
                s = s._replace(**{field: found}) if found else s
            elif do == "gs":
                s = s._replace(ext=op["name"] if op["name"] is not None else s.ext)
            elif do in SHOW or do in LINE:
                if do in LINE:
                    moved = None
                    if do == "BT":
                        moved = IDENTITY
                    elif do == "Tm":
                        moved = tuple(n[-6:]) if len(n) >= 6 else None
                    elif do in ("Td", "TD"):
                        moved = times((1, 0, 0, 1, n[0], n[1]), matrix) if len(n) >= 2 else None
                        s = s._replace(leading=-n[1]) if do == "TD" and moved else s
                    else:
                        s = s._replace(word_space=n[0], char_space=n[1]) if do == '"' and len(n) >= 2 else s
                        moved = times((1, 0, 0, 1, 0, -s.leading), matrix)
                    if moved:
                        self.lines += 1
                        matrix, line = moved, self.lines
                if do in SHOW:
                    parts = op["parts"] if do == "TJ" else [p for p in op["parts"] if p["value"] is not None][:1]
                    if parts and s.font is not None:
                        yield self.event(stream, "text", op, s, len(stack), parts=parts, line_matrix=list(matrix), line_id=line)
            elif do in ("m", "l", "c", "v", "y", "re"):
                pairs = [n[-2:]] if do in "ml" else [n[-4:-2], [n[-4] + n[-2], n[-3] + n[-1]]] if do == "re" and len(n) >= 4 else [n[k : k + 2] for k in range(0, len(n) - 1, 2)] if do in "cvy" else []
                found = [times((1, 0, 0, 1, *p), s.ctm)[4:] for p in pairs if len(p) == 2]
                path_start = op["start"] if found and path_start is None else path_start
                points += found
                whole = do != "re" or bool(found)
                rects, steps = rects + (do == "re" and whole), steps + whole
            elif do == "h":
                path_start = op["start"] if path_start is None else path_start
            elif do in ("W", "W*"):
                clips = True
            elif do in PAINT:
                box = (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points)) if points else None
                at = op | {"start": op["start"] if path_start is None else path_start}
                if clips:
                    if rects == steps == 1 and box:
                        was = s.clip or box
                        s = s._replace(clip=(max(was[0], box[0]), max(was[1], box[1]), min(was[2], box[2]), min(was[3], box[3])))
                    else:
                        s = s._replace(clip_complex=True)
                    yield self.event(stream, "clip", at, s, len(stack))
                elif do != "n" and box:
                    yield self.event(stream, "path", at, s, len(stack), **dict(zip(("x0", "y0", "x1", "y1"), box)))
                points, path_start, rects, steps, clips = [], None, 0, 0, False
            elif do == "Do" and depth < MOST_DEPTH and (held := self.objects.get((source, op["name"]))):
                if held["kind"] == "image":
                    corners = [times((1, 0, 0, 1, x, y), s.ctm)[4:] for x in (0, 1) for y in (0, 1)]
                    xs, ys = zip(*corners)
                    yield self.event(stream, "image", op, s, len(stack), name=op["name"], x0=min(xs), y0=min(ys), x1=max(xs), y1=max(ys))
                else:
                    yield self.event(stream, "form", op, s, len(stack), name=op["name"])
                    inner = tuple(held["matrix"][:6]) if held["matrix"] and len(held["matrix"]) >= 6 else IDENTITY
                    yield from self.play(held["target"], f"{stream}>{op['name']}", State(times(inner, s.ctm), s.clip, s.clip_complex), depth + 1)


def _corners(n: np.ndarray, ctm: Matrix) -> list[tuple[float, float]]:
    """Points (pairs of numbers) in the space of the page; of many, two that span the same box."""
    if len(n) >= MANY:
        x, y = n[::2], n[1::2]
        x, y = x * ctm[0] + y * ctm[2] + ctm[4], x * ctm[1] + y * ctm[3] + ctm[5]
        box = [(float(x.min()), float(y.min())), (float(x.max()), float(y.max()))]
        if np.isfinite(box).all():
            return box
    n = n.tolist()
    return [times((1, 0, 0, 1, *p), ctm)[4:] for p in zip(n[::2], n[1::2])]


def operations(tokens: DataFrame, stream: list[str]) -> DataFrame:
    """``(<stream>, k, op, start, end, name, parts)``: the operators of each stream of ``lexer.lexed`` with their operands; operands that no operator follows are left out."""
    ends = F.col("kind").isin("operator", "image")
    order = W.partitionBy(*stream).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    rows = tokens.withColumn("k", F.coalesce(F.sum(ends.cast("long")).over(order), F.lit(0)))
    value = F.when(F.col("kind").isin("string", "hex"), F.col("value"))
    part = F.when(value.isNotNull() | F.col("number").isNotNull(), F.struct("n", value.alias("value"), F.col("number").alias("number")))
    rows = rows.groupBy(*stream, "k").agg(
        F.max(F.when(ends, F.when(F.col("kind") == "image", "BI").otherwise(F.decode("value", "ISO-8859-1")))).alias("op"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by(F.when(F.col("kind") == "name", F.decode("value", "UTF-8")), F.when(F.col("kind") == "name", F.col("n"))).alias("name"),
        F.transform(F.array_sort(F.collect_list(part)), lambda p: F.struct(p["value"].alias("value"), p["number"].alias("number"))).alias("parts"),
    )
    return rows.where("op is not null")


def _read(data: bytes) -> Iterator[tuple[str, int, int, str | None, list[dict]]]:
    """``(op, start, end, name, parts)`` of each operation of a stream."""
    begin, name, parts = None, None, []
    for kind, start, end, value, number in lexer.tokens(data):
        begin = start if begin is None else begin
        if kind in ("operator", "image"):
            yield "BI" if kind == "image" else value.decode("iso-8859-1"), begin, end, name, parts
            begin, name, parts = None, None, []
        elif kind == "name" and name is None:
            name = value.decode("utf-8", "replace")
        elif kind in ("string", "hex"):
            parts.append({"value": value, "number": None})
        elif number is not None:
            parts.append({"value": None, "number": number})


#: Bytes that make a stream more than words, and for each byte whether it is white space, and whether it can stand in a plain number.
NOT_WORDS = re.compile(rb"[()<>\[\]{}/%\x00\x0b]")
WHITE, DIGIT = (np.isin(np.arange(256), list(c)) for c in (b"\t\n\x0c\r ", b"+-.0123456789"))


def _read_words(data: bytes) -> Iterator[dict] | None:
    """Operations of a stream that is of plain numbers and operators alone, as ``Page`` plays them, steps of a path as one of op None, without those that it does not know; else None."""
    if not data or NOT_WORDS.search(data):
        return None
    byte = np.frombuffer(data, np.uint8)
    white = WHITE[byte]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    is_number = DIGIT[byte[starts]]
    if not len(starts) or (is_number & np.logical_or.reduceat(~(DIGIT | WHITE)[byte], starts)).any():
        return None
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(byte[~white])])
    try:
        numbers = words.filter(pa.array(is_number)).cast(pa.string()).cast(pa.float64()).to_numpy()
    except pa.ArrowInvalid:  # only its beginning is a number, or nothing is
        return None
    at = np.flatnonzero(~is_number)
    found = words.take(pa.array(at)).dictionary_encode()
    names, which = found.dictionary.to_pylist(), found.indices.to_numpy()
    if b"BI" in names or not names:
        return None
    before = np.concatenate([[-1], at[:-1]])
    n, stops = at - before - 1, np.cumsum(is_number)[at]
    step = n == np.array([STEPS.get(w, -1) for w in names])[which]
    # steps in a row are one
    first = np.flatnonzero(~(step & np.concatenate([[False], step[:-1]])))
    last = np.append(first[1:], len(at)) - 1
    met = step[first] | np.array([w in PLAYED for w in names])[which[first]]
    first, last = first[met], last[met]
    names = [w.decode("iso-8859-1") for w in names]
    rows = (step[first], which[first], starts[before[first] + 1], ends[at[last]], stops[first] - n[first], stops[last], last - first + 1)
    listed = numbers.tolist()
    return (
        {"op": None, "start": a, "end": b, "numbers": numbers[i:j], "steps": k} if path else {"op": names[w], "start": a, "end": b, "name": None, "parts": (), "numbers": listed[i:j]}
        for path, w, a, b, i, j, k in zip(*(r.tolist() for r in rows))
    )


def operated(streams: DataFrame, content: str, *stream: str) -> DataFrame:
    """``operations`` of the tokens of each row's ``content``, a row a stream: put together as they are read, so that tokens are no rows and are neither dealt nor sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out = [(k, *found) for k, found in enumerate(_read(batch.column(len(stream))[row].as_py() or b""))]
                if out:
                    own = [pa.array([batch.column(k)[row].as_py()] * len(out), batch.schema.field(k).type) for k in range(len(stream))]
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("value", pa.binary()), ("number", pa.float64())])))
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=[*stream, "k", "op", "start", "end", "name", "parts"])

    rows = streams.select(*stream, streams[content].cast("binary"))
    schema = StructType(rows.schema.fields[:-1])
    for field in StructType.fromDDL("k long, op string, start long, end long, name string, parts array<struct<value: binary, number: double>>"):
        schema = schema.add(field)
    return rows.mapInArrow(run, schema)


def _records(table: pa.Table) -> Iterator[dict]:
    """Rows of operations as dicts; their parts are taken from flat columns, which is faster than row by row."""
    names = [c for c in table.column_names if c != "parts"]
    parts = table["parts"].combine_chunks()
    parts = pa.concat_arrays(parts.chunks) if isinstance(parts, pa.ChunkedArray) else parts
    flat = parts.flatten()
    made = [{"value": v, "number": x} for v, x in zip(flat.field("value").to_pylist(), flat.field("number").to_pylist())]
    at = 0
    for n, *row in zip(pc.list_value_length(parts).fill_null(0).to_pylist(), *(table[c].to_pylist() for c in names)):
        yield dict(zip(names, row), parts=made[at : at + n])
        at += n


def events(operations: DataFrame, objects: DataFrame | None, page: list[str]) -> DataFrame:
    """What each page's stream ``page`` does, in order: text, path and image (numbered by seq from 0), and open, close, matrix, clip and form without a seq.

    ``operations``: ``(<page>, stream, k, ...)`` of the streams of each page. ``objects``: ``(<page>, stream, name, kind, target, matrix)``, kind image or form,
    the stream ``target`` of that page being what a form draws; forms more than eight deep draw nothing, so one that holds itself is drawn eight times. Pages without a stream ``page`` have no
    events. Dashes are not followed. Null names of objects are not met. The start of open and close is that of the operator, of all else that of its first operand.
    """
    rows = operations.select(*page, "stream", "k", "op", "start", "end", "name", "parts", F.lit(None).cast("string").alias("target"), F.lit(None).cast("array<double>").alias("matrix"))
    if objects is not None:
        rows = rows.unionByName(objects.select(*page, "stream", "name", F.col("kind").alias("op"), "target", "matrix", F.lit(-1).cast("long").alias("k")), allowMissingColumns=True)
    schema = StructType([rows.schema[c] for c in page])
    for field in StructType.fromDDL(EVENT):
        schema = schema.add(field)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        streams, held = {}, {}
        for row in _records(group.sort_by("k")):
            if row["k"] < 0:
                held[row["stream"], row["name"]] = {"kind": row["op"], "target": row["target"], "matrix": row["matrix"]}
            else:
                streams.setdefault(row["stream"], []).append(row)
        found = list(Page(streams, held).play(ROOT, ROOT, State(IDENTITY)))
        own = dict(zip(page, (k.as_py() for k in key)))
        return pa.Table.from_pylist([{c: own[c] if c in own else e.get(c) for c in to_arrow.names} for e in found], schema=to_arrow)

    to_arrow = to_arrow_schema(schema)
    return rows.groupBy(*page).applyInArrow(run, schema)


def replayed(streams: DataFrame, content: str, objects: DataFrame | None, page: list[str], kinds: Iterable[str] = (), fields: Iterable[str] = ()) -> DataFrame:
    """``events`` of streams ``(<page>, stream, <content>)``, binary, a row a stream: only streams are dealt, as operations are read where their page is played.

    kinds, fields: which events, and which of their columns, are made; none: all.
    """
    rows = streams.select(*page, F.struct("stream", streams[content].cast("binary").alias("content")).alias("_s"))
    if objects is not None:
        rows = rows.unionByName(objects.select(*page, F.struct("stream", "name", "kind", "target", "matrix").alias("_o")), allowMissingColumns=True)
    held = F.collect_list("_o") if objects is not None else F.lit(None)
    return pages_replayed(rows.groupBy(*page).agg(F.collect_list("_s").alias("streams"), held.alias("objects")), page, kinds, fields)


def pages_replayed(rows: DataFrame, page: list[str], kinds: Iterable[str] = (), fields: Iterable[str] = ()) -> DataFrame:
    """``replayed`` of pages that hold their own streams (structs stream, content) and objects (structs stream, name, kind, target, matrix; null: none), a row a page."""
    rows = rows.select(*page, "streams", "objects")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for *key, streams, objects in zip(*batch.columns):
                own: dict[str, bytes] = {}
                for s in streams.as_py() or ():
                    own[s["stream"]] = own.get(s["stream"], b"") + (s["content"] or b"")
                yield [k.as_py() for k in key], own, objects.as_py() or ()

    return _replayed(rows, page, pages, kinds, fields)


def pieces_replayed(rows: DataFrame, page: list[str], kinds: Iterable[str] = (), fields: Iterable[str] = ()) -> DataFrame:
    """``replayed`` of pages without objects whose stream ``page`` comes in pieces: rows ``(<page>, content)``, of which each page's stand together in one task, in order. They are neither dealt nor sorted here."""
    rows = rows.select(*page, F.col("content").cast("binary").alias("content"))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own, held = None, []
        for batch in batches:
            *keys, content = (c.to_pylist() for c in batch.columns)
            for key, piece in zip(zip(*keys), content):
                if key != own:
                    if held:
                        yield own, {ROOT: b"".join(held)}, ()
                    own, held = key, []
                held.append(piece or b"")
        if held:
            yield own, {ROOT: b"".join(held)}, ()

    return _replayed(rows, page, pages, kinds, fields)


def _replayed(rows: DataFrame, page: list[str], pages: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], kinds: Iterable[str], fields: Iterable[str]) -> DataFrame:
    """Events of the ``(key, streams, objects)`` that ``pages`` makes of a task's batches."""
    schema = StructType([rows.schema[c] for c in page] + [f for f in StructType.fromDDL(EVENT) if not fields or f.name in fields])
    arrow, kinds = to_arrow_schema(schema), frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, out = [], []

        def whole() -> pa.RecordBatch:
            columns = [*(list(zip(*keys))), *([e.get(f.name) for e in out] for f in list(arrow)[len(page) :])]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for key, streams, objects in pages(batches):
            held = {(o["stream"], o["name"]): o for o in objects}
            found = [e for e in Page(_Streams(streams), held, kinds).play(ROOT, ROOT, State(IDENTITY)) if e]
            keys += [key] * len(found)
            out += found
            if len(out) >= MOST_EVENTS:
                yield whole()
                keys, out = [], []
        if out:
            yield whole()

    return rows.mapInArrow(run, schema)


class _Streams:
    """A page's streams by name, read when they are asked for."""

    def __init__(self, content: dict[str, bytes]):
        self.content = content

    def get(self, name: str, none: tuple = ()) -> Iterable[dict]:
        data = self.content.get(name)
        if data is None:
            return none
        names = ("op", "start", "end", "name", "parts")
        return _read_words(data) or (dict(zip(names, found)) for found in _read(data))


def _codes(value: bytes, two_byte: bool) -> np.ndarray:
    """The codes of a string: each byte, or each whole pair of bytes."""
    return np.frombuffer(value, ">u2", len(value) // 2) if two_byte else np.frombuffer(value, np.uint8)


class _Face:
    """A font with its glyphs, as a task holds it while the font's texts pass: widths and texts of its codes."""

    def __init__(self, two_byte: bool, missing_width: float | None):
        n = 1 << 16 if two_byte else 1 << 8
        self.two_byte, self.widths, self.glyphs = two_byte, np.full(n, np.nan if missing_width is None else missing_width), np.full(n, "", object)
        self.texts = None

    def add(self, codes: np.ndarray, glyphs: pa.Array, widths: pa.Array) -> None:
        mine = (codes >= 0) & (codes < len(self.widths))
        codes, wide = codes[mine], widths.fill_null(float("nan")).to_numpy(zero_copy_only=False)[mine]
        self.glyphs[codes] = glyphs.fill_null("").to_numpy(zero_copy_only=False)[mine]
        known = widths.is_valid().to_numpy(zero_copy_only=False)[mine]
        self.widths[codes[known]], self.texts = wide[known], None

    def measured(self, rows: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
        """Text of each row's parts and how far they move, in the space of its text matrix; all codes of all rows at once."""
        if self.texts is None:
            self.texts = pa.array(self.glyphs, pa.string())
        parts = rows["parts"]
        n_parts = np.asarray(pc.list_value_length(parts).fill_null(0).to_numpy(zero_copy_only=False), "i8")
        row, flat = np.repeat(np.arange(rows.num_rows), n_parts), parts.flatten()
        values, numbers = pc.struct_field(flat, "value"), pc.struct_field(flat, "number")
        is_number = numbers.is_valid().to_numpy(zero_copy_only=False)
        width = 2 if self.two_byte else 1
        values = pc.if_else(pa.array(is_number), b"", values.fill_null(b""))
        long = np.asarray(pc.binary_length(values).to_numpy(zero_copy_only=False), "i8") // width
        data = b"".join(v[: k * width] for v, k in zip(values.to_pylist(), long.tolist()))
        codes = np.frombuffer(data, ">u2" if self.two_byte else np.uint8).astype(np.int32)
        part = np.repeat(np.arange(len(flat)), long)
        size, scale, char_space, word_space = (rows[c].to_numpy(zero_copy_only=False)[row] for c in ("size", "scale", "char_space", "word_space"))
        wide = np.bincount(part, self.widths[codes], len(flat)) / 1000 * size + long * char_space
        if not self.two_byte:
            wide += np.bincount(part, codes == 32, len(flat)) * word_space
        back = -numbers.fill_null(0.0).to_numpy(zero_copy_only=False) / 1000 * scale
        by = np.bincount(row, np.where(is_number, back * size, wide * scale), rows.num_rows)
        said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long)]), pa.int32()), self.texts.take(pa.array(codes))), "")
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_parts)]), pa.int32()), said), "")
        # a wide gap reads as a space behind what does not end in one; what shows nothing ends no text
        gapped = np.unique(row[is_number & (back > WORD_GAP)])
        if len(gapped):
            start, texts = np.cumsum(n_parts) - n_parts, []
            for k in gapped.tolist():
                own = slice(start[k], start[k] + n_parts[k])
                text = ""
                for piece, gap in zip(said[own].to_pylist(), (is_number & (back > WORD_GAP))[own].tolist()):
                    text += " " if gap and text and not text.endswith(" ") else piece
                texts.append(text)
            marked = np.zeros(rows.num_rows, bool)
            marked[gapped] = True
            whole = pc.replace_with_mask(whole, pa.array(marked), pa.array(texts, pa.string()))
        return whole, pa.array(by)


def _set(row: dict, shapes: dict[int, tuple[str, float | None]]) -> tuple[str, float]:
    """Text of a row's parts and how far they move, in the space of its text matrix."""
    size, scale, text, by = row["size"], row["scale"], [], 0.0
    for part in row["parts"]:
        if part["number"] is not None:
            back = -part["number"] / 1000 * scale
            if back > WORD_GAP and text and text[-1] and not text[-1].endswith(" "):
                text.append(" ")
            by += back * size
        elif part["value"]:
            codes = _codes(part["value"], row["two_byte"])
            shown = "".join(shapes[c][0] for c in codes.tolist() if c in shapes)
            # what shows nothing ends no text
            text += [shown] if shown else []
            for code, n in zip(*(x.tolist() for x in np.unique(codes, return_counts=True))):
                wide = shapes[code][1] if code in shapes and shapes[code][1] is not None else row["missing_width"]
                space = row["word_space"] if code == 32 and not row["two_byte"] else 0.0
                by += n * (wide / 1000 * size + row["char_space"] + space) * scale
    return "".join(text), by


def _measured(rows: DataFrame, page: list[str], state: list[str]) -> DataFrame:
    """Texts among ``rows`` (kind 2), behind their font's face (kind 0) and glyphs (kind 1), with text and by."""
    out = [*page, *state, "ascent", "descent", "confident"]
    schema = StructType([rows.schema[c] for c in out]).add("text", StringType()).add("by", DoubleType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, face, own = None, None, ()
        for batch in batches:
            keys = list(zip(batch["font"].to_pylist(), batch["salt"].to_pylist(), batch["kind"].to_pylist()))
            starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for start, stop in zip(starts, [*starts[1:], len(keys)]):
                part, (font, salt, kind) = batch.slice(start, stop - start), keys[start]
                if (font, salt) != place:
                    place, face = (font, salt), None
                if kind == 0:
                    own = [part[c].slice(0, 1) for c in ("ascent", "descent", "confident")]
                    face = _Face(part["two_byte"][0].as_py(), part["missing_width"][0].as_py())
                elif face and kind == 1:
                    face.add(part["code"].to_numpy(zero_copy_only=False), part["glyph"], part["width"])
                elif face:
                    same = [c.take(pa.array(np.zeros(part.num_rows, np.int64))) for c in own]
                    yield pa.RecordBatch.from_arrays([*part.select([*page, *state]).columns, *same, *face.measured(part)], schema=arrow)

    return rows.mapInArrow(run, schema)


def runs(events: DataFrame, fonts: DataFrame, glyphs: DataFrame, page: list[str], salts: int = SALTS) -> DataFrame:
    """Placed runs, as ``layout.grouped_runs`` takes them, of the texts among ``events``, with op, start, end, x and y beside.

    ``fonts``: ``(font, two_byte, missing_width, ascent, descent, confident)``, a row each; ``glyphs``: ``(font, code, glyph, width)``, a row a code, widths in thousandths of the size.
    Texts of a font that is not there are left out and move nothing, as they cannot be measured. Codes without a glyph are no text; without a width, they have the font's missing width.
    Rows with a null in ``page`` are left out. Texts are dealt by font and one of ``salts`` parts, where they pass behind the font's glyphs, and then once by page.
    """
    state = ["seq", "stream", "op", "start", "end", "font", "size", "scale", "rise", "mode", "fill", "ctm", "line_matrix", "line_id"]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
    texts = events.where("kind = 'text'").where(" and ".join(f"`{c}` is not null" for c in page))
    texts = texts.select(*page, *state, "char_space", "word_space", "parts", F.pmod(F.xxhash64(*page), F.lit(salts)).alias("salt"), F.lit(2).alias("kind"))
    face = fonts.where("font is not null").select("font", "two_byte", *(F.col(c).cast("double").alias(c) for c in ("missing_width", "ascent", "descent")), "confident", every, F.lit(0).alias("kind"))
    known = glyphs.where("font is not null and code is not null").select("font", F.col("code").cast("long").alias("code"), "glyph", F.col("width").cast("double").alias("width"), every, F.lit(1).alias("kind"))
    rows = texts.unionByName(known, allowMissingColumns=True).unionByName(face, allowMissingColumns=True)
    rows = _measured(rows.repartition("font", "salt").sortWithinPartitions("font", "salt", "kind"), page, state)
    # lines' running sums and whatever groups a page's runs need no other shuffle
    rows = rows.repartition(*page)
    size, scale = F.col("size"), F.col("scale")
    before = W.partitionBy(*page, "line_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_shift", F.coalesce(F.sum("by").over(before), F.lit(0.0)))
    m, c = [F.get("line_matrix", k) for k in range(6)], [F.get("ctm", k) for k in range(6)]
    m[4], m[5] = F.col("_shift") * m[0] + m[4], F.col("_shift") * m[1] + m[5]
    to_page = times(tuple(m), tuple(c))
    rows = rows.withColumn("_m", F.array(*to_page))
    a, b, down_x, down_y, e, f = (F.get("_m", k) for k in range(6))
    long, tall = F.hypot(a, b), F.hypot(size * down_x, size * down_y)
    flow = F.when(size * scale < 0, -1.0).otherwise(1.0)
    long = F.when(long == 0, 1.0).otherwise(long)
    rows = rows.withColumns({"x": F.col("rise") * down_x + e, "y": F.col("rise") * down_y + f, "dir_x": a / long * flow, "dir_y": b / long * flow, "_size": F.when(tall == 0, size).otherwise(tall), "advance": F.col("by") * long * flow})
    u, v = F.col("x") * F.col("dir_x") + F.col("y") * F.col("dir_y"), F.col("y") * F.col("dir_x") - F.col("x") * F.col("dir_y")
    return rows.select(
        *page, "seq", "stream", "op", "start", "end", "text", "font", F.col("_size").alias("size"), "fill", "mode", "dir_x", "dir_y", "x", "y", u.alias("u"), v.alias("v"),
        "advance", "ascent", "descent", "confident",
    )
