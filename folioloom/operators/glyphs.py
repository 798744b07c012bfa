"""Fonts as tables: codes and what they stand for from CMap streams, widths from arrays, and text written in the codes of a font.

A CMap's sections are read in one pass over its tokens and leave as ranges, which columns spread out, as they do for widths. Text is
encoded by the longest piece that a font knows. Texts are dealt by font and salt and pass behind their font's glyphs, so a font that
a third of all texts use stands in many tasks, and a task holds one font, of whose codes there are 65,536 at most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import lexer
from .replay import SALTS

#: The most codes of one range, the longest piece that one code stands for, and the width of a space that a font does not have.
MOST_CODES, LONGEST, SPACE = 65_536, 4, 250.0
#: Characters whose codes leave a task at once.
MOST_CHARS = 1 << 20


def _ranges(data: bytes) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """``(low, high, text, name)`` of a CMap's bfchar and bfrange sections, in order; what does not fit its section is stepped over."""
    tokens = [(kind, value) for kind, _, _, value, _ in lexer.tokens(data)]
    is_text = lambda k: k < len(tokens) and tokens[k][0] in ("string", "hex")
    number = lambda k: int.from_bytes(tokens[k][1][-4:], "big")
    section, at = None, 0
    while at < len(tokens):
        kind, value = tokens[at]
        if kind == "operator" and value in (b"beginbfchar", b"endbfchar", b"beginbfrange", b"endbfrange"):
            section = value[5:] if value[:5] == b"begin" else None
            at += 1
        elif section == b"bfchar" and is_text(at) and at + 1 < len(tokens) and (is_text(at + 1) or tokens[at + 1][0] == "name"):
            text = is_text(at + 1)
            yield number(at), number(at), tokens[at + 1][1] if text else None, None if text else tokens[at + 1][1].decode("latin-1")
            at += 2
        elif section == b"bfrange" and is_text(at) and is_text(at + 1) and at + 2 < len(tokens):
            low, high = number(at), number(at + 1)
            if is_text(at + 2):
                yield low, min(high, low + MOST_CODES - 1), tokens[at + 2][1], None
            at += 3
            if tokens[at - 1] == ("open", b"["):
                while at < len(tokens) and tokens[at] != ("close", b"]"):
                    if is_text(at):
                        yield low, low, tokens[at][1], None
                        low += 1
                    at += 1
                at += 1
        else:
            at += 1


def cmap_ranges(streams: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(<keep>, n, low, high, text, name)``: what each CMap stream says, in order; null and empty streams say nothing. The text (UTF-16, big-endian) is that of ``low``; a name stands for one glyph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, n, *found) for k, data in enumerate(batch.column(len(keep)).to_pylist()) for n, found in enumerate(_ranges(data or b""))]
            if out:
                at, *columns = zip(*out)
                own = batch.select(list(keep)).take(pa.array(at)).columns
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t.type) for c, t in zip(columns, list(arrow)[len(keep) :]))], names=arrow.names)

    rows = streams.select(*keep, streams[content].cast("binary"))
    schema = StructType(rows.schema.fields[:-1])
    for field in StructType.fromDDL("n long, low long, high long, text binary, name string"):
        schema = schema.add(field)
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def glyph_text(name: Column) -> Column:
    """What a glyph's name says by itself, up to a full stop: uniXXXX, uXXXX to uXXXXXX, or a single character; else null, as for half a surrogate pair."""
    plain = _plain(name)
    code = F.greatest(F.regexp_extract(plain, r"^uni([0-9A-Fa-f]{4})", 1), F.regexp_extract(plain, r"^u([0-9A-Fa-f]{4,6})$", 1))
    number = F.when(code != "", F.conv(code, 16, 10).cast("long"))
    whole = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(whole, F.decode(F.unhex(F.lpad(code, 8, F.lit("0"))), "UTF-32")).when(number.isNull() & (F.length(plain) == 1), plain)


def _plain(name: Column) -> Column:
    return F.when(name.startswith("."), name).otherwise(F.substring_index(name, ".", 1))


def code_map(ranges: DataFrame, key: list[str], names: DataFrame | None = None) -> DataFrame:
    """``(<key>, code, glyph)``: each code once, as the last range says. In a range, the last two bytes count up and wrap; names come from ``names`` ``(name, glyph)``, else from themselves; unknown ones are left out."""
    rows = ranges.where("high >= low").select(*key, "n", "low", "text", "name", F.explode(F.sequence("low", "high")).alias("code"))
    digits = F.hex("text")
    tail = F.when(F.length(digits) >= 4, 4).otherwise(2)
    count = (F.conv(F.right(digits, tail), 16, 10).cast("long") + F.col("code") - F.col("low")) % F.when(tail == 4, 65_536).otherwise(256)
    moved = F.concat(F.substring(digits, F.lit(1), F.length(digits) - tail), F.lpad(F.hex(count), tail, F.lit("0")))
    # a lone byte is a character by itself, a last odd byte is nothing
    even = F.when(F.length(moved) == 2, F.concat(F.lit("00"), moved)).otherwise(F.substring(moved, F.lit(1), F.floor(F.length(moved) / 4).cast("int") * 4))
    # half a surrogate pair becomes the replacement character
    even = F.regexp_replace(even, r"\G((?:[0-9A-CEF]...|D[0-7]..|D[89AB]..D[C-F]..)*+)D[89A-F]..", "$1FFFD")
    text = F.when(digits == "", "").otherwise(F.decode(F.unhex(even), "UTF-16BE"))
    if names is not None:
        rows = rows.withColumn("plain", _plain(F.col("name"))).join(names.select(F.col("name").alias("plain"), F.col("glyph").alias("named")), "plain", "left")
    named = glyph_text(F.col("name")) if names is None else F.coalesce("named", glyph_text(F.col("name")))
    rows = rows.withColumn("glyph", F.when(F.col("name").isNotNull(), named).otherwise(text)).where("glyph is not null")
    return rows.groupBy(*key, "code").agg(F.max_by("glyph", "n").alias("glyph"))


def code_widths(rows: DataFrame, key: list[str]) -> DataFrame:
    """``(<key>, code, width)`` of rows ``(<key>, n, first, last, widths)``: the array's values from ``first`` on if ``last`` is null (nulls in it are left out), else its first value for each code of first to last, 65,536 at most; the highest n wins."""
    one = F.array_repeat(F.get("widths", 0), F.greatest(F.lit(0), F.least(F.col("last") - F.col("first") + 1, F.lit(MOST_CODES))).cast("int"))
    found = rows.select(*key, "n", "first", F.posexplode(F.when(F.col("last").isNull(), F.col("widths")).otherwise(one)).alias("k", "width")).where("width is not null")
    return found.groupBy(*key, (F.col("first") + F.col("k")).cast("long").alias("code")).agg(F.max_by("width", "n").cast("double").alias("width"))


class _Face:
    """A font with its glyphs, as a task holds it while the font's texts pass."""

    def __init__(self, two_byte: bool, missing_width: float | None, space_width: float):
        self.two_byte, self.missing_width, self.space_width = two_byte, missing_width, space_width
        self.codes: dict[str, bytes] = {}
        self.widths: dict[str, float | None] = {}
        self.longer, self.pattern = [], None

    def add(self, piece: str, code: int, width: float | None) -> None:
        self.codes[piece] = (code & (0xFFFF if self.two_byte else 0xFF)).to_bytes(2 if self.two_byte else 1, "big")
        self.widths[piece] = width if width is not None else self.missing_width
        if len(piece) > 1:
            self.longer.append(piece)
            self.pattern = None

    def pieces(self, text: str) -> list[str]:
        """The longest known piece at each place, else its character."""
        if not self.longer:
            return list(text)
        if self.pattern is None:
            # pieces that begin alike stand together, so a place tries those of its own character alone
            of: dict[str, list[str]] = {}
            for piece in sorted(self.longer, key=lambda p: (-len(p), p)):
                of.setdefault(piece[0], []).append(re.escape(piece[1:]))
            self.rest = {head: re.compile("(?:" + "|".join(tails) + ")?", re.S) for head, tails in of.items()}
            self.pattern = re.compile("[" + "".join(map(re.escape, of)) + "]")
        out, at = [], 0
        while found := self.pattern.search(text, at):
            out += text[at : found.start()]
            at = self.rest[found[0]].match(text, found.end()).end()
            out.append(text[found.start() : at])
        out += text[at:]
        return out


def _encode(text: str, font: _Face) -> tuple[list[tuple[bytes | None, float | None]] | None, float | None, int, list[str], list[tuple[str, bool]]]:
    """Parts, width, glyphs, what is missing (in order, once) and spans of what is there and what is not."""
    codes, widths = font.codes, font.widths
    pieces = font.pieces(text)
    times = Counter(pieces)
    n = sum(c for p, c in times.items() if p in codes)
    missing = [p for p in times if p not in codes and p != " "]
    if missing:
        spans, so_far, held = [], None, []
        for p in pieces:
            # a space is never missing, and belongs to what stands before it
            there = so_far is not False if p == " " else p in codes
            if there is not so_far and held:
                spans.append(("".join(held), so_far))
                held = []
            so_far = there
            held.append(p)
        spans.append(("".join(held), so_far))
        return None, None, n, missing, spans
    gap = " " not in codes
    wide = {p: font.space_width if gap and p == " " else widths[p] for p in times}
    width = reduce(add, map(wide.__getitem__, pieces), 0.0)
    parts, start = [], 0
    for k in [*((k for k, p in enumerate(pieces) if p == " ") if gap and " " in times else ()), len(pieces)]:
        if k > start:
            parts.append((b"".join(map(codes.__getitem__, pieces[start:k])), None))
        if k < len(pieces):
            parts.append((None, -font.space_width))
        start = k + 1
    return parts, width, n, [], [(text, True)] if text else []


def _listed(lists: list[list[tuple] | None], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as an array of lists of structs, null where there is no list."""
    ends = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])])
    offsets = pa.array(ends, pa.int32(), mask=np.array([x is None for x in lists] + [False]))
    columns = list(zip(*(t for x in lists for t in x or ()))) or [()] * kind.value_type.num_fields
    fields = [kind.value_type.field(k) for k in range(kind.value_type.num_fields)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)).cast(kind)


def encoded(texts: DataFrame, fonts: DataFrame, glyphs: DataFrame, page: list[str], salts: int = SALTS) -> DataFrame:
    """Rows of ``texts`` ``(<page>, id, font, text)`` with parts as a TJ array takes them, width (thousandths of the size), n_glyphs, missing and spans ``(text, there)``.

    ``fonts``: ``(font, two_byte, missing_width, space_width)``; ``glyphs``: ``(font, code, glyph, width)``; of codes for one glyph the lowest counts. A space that the font lacks is a gap of
    ``space_width`` (null: 250). If anything is missing, parts and width are null. Null texts count as empty; texts of fonts that are not there, or with a null in ``page``, are left out.
    ``salts``: into how many parts each font's texts are dealt; its glyphs go to each part, where they pass before the texts, so what a task holds is one font.
    """
    by_text = glyphs.where(f"length(glyph) between 1 and {LONGEST}").groupBy("font", "glyph").agg(F.min_by(F.struct(F.col("code").cast("long").alias("code"), F.col("width").cast("double").alias("width")), "code").alias("g"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
    texts = texts.select(*page, "id", "font", F.coalesce("text", F.lit("")).alias("text"))
    own = [*page, "id"]
    none = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in own]
    face = fonts.where("font is not null").select(*none, "font", F.lit(None).cast("string").alias("text"), every, F.lit(0).alias("kind"), "two_byte", F.col("missing_width").cast("double").alias("wide"), F.coalesce(F.col("space_width").cast("double"), F.lit(SPACE)).alias("space"), F.lit(None).cast("long").alias("code"))
    known = by_text.select(*none, "font", F.col("glyph").alias("text"), every, F.lit(1).alias("kind"), F.lit(None).cast("boolean").alias("two_byte"), F.col("g.width").alias("wide"), F.lit(None).cast("double").alias("space"), F.col("g.code").alias("code"))
    there = texts.where(" and ".join(f"`{c}` is not null" for c in [*page, "font"]))
    asked = there.select(*own, "font", "text", F.pmod(F.xxhash64(*own), F.lit(salts)).alias("salt"), F.lit(2).alias("kind"), F.lit(None).cast("boolean").alias("two_byte"), *(F.lit(None).cast(t).alias(c) for c, t in (("wide", "double"), ("space", "double"), ("code", "long"))))
    rows = asked.unionByName(known).unionByName(face).repartition("font", "salt").sortWithinPartitions("font", "salt", "kind")
    schema = StructType([texts.schema[c] for c in (*own, "font", "text")])
    for field in StructType.fromDDL("parts array<struct<value: binary, number: double>>, width double, n_glyphs long, missing array<string>, spans array<struct<text: string, there: boolean>>"):
        schema = schema.add(field)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, font = None, None
        for batch in batches:
            start, held = 0, 0
            # a long text more or less: what leaves at once is bounded by its characters
            for stop, n in enumerate(pc.utf8_length(batch["text"]).to_pylist(), 1):
                held += n or 0
                if held < MOST_CHARS and stop < batch.num_rows:
                    continue
                part, at, out = batch.slice(start, stop - start), [], []
                for k, r in enumerate(part.select(["font", "salt", "kind", "text", "two_byte", "wide", "space", "code"]).to_pylist()):
                    if (r["font"], r["salt"]) != place:
                        place, font = (r["font"], r["salt"]), None
                    if r["kind"] == 0:
                        font = _Face(r["two_byte"], r["wide"], r["space"])
                    elif font and r["kind"] == 1:
                        font.add(r["text"], r["code"], r["wide"])
                    elif font:
                        at.append(k)
                        out.append(_encode(r["text"], font))
                if at:
                    kept = part.select([*own, "font", "text"]).take(pa.array(at))
                    found = [(_listed if f.name in ("parts", "spans") else pa.array)(list(c), f.type) for c, f in zip(zip(*out), list(arrow)[-5:])]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *found], schema=arrow)
                start, held = stop, 0

    return rows.mapInArrow(run, schema)
