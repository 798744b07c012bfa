"""Tokens of content streams with their byte places and values: nested and escaped strings, names, numbers, inline images.

Bytes are matched by one pattern; only what a pattern cannot say (strings nest, images hold anything) is followed by hand. A
stream that ends inside a token ends it. Each row's stream is read on its own, so Spark deals out streams and a token table follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType

#: White space, delimiters, and what the letters after a backslash stand for.
WHITE, DELIMITERS = rb"\x00\t\n\x0c\r ", rb"()<>\[\]{}/%"
LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_REGULAR = rb"[^" + WHITE + DELIMITERS + rb"]"
TOKEN = re.compile(
    rb"(?:[" + WHITE + rb"]+|%[^\r\n]*)*+(?:(?P<name>/" + _REGULAR + rb"*)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<stray>>)|(?P<hex><[^>]*>?)|(?P<string>\()|(?P<word>" + _REGULAR + rb"+)|(?P<mark>[\s\S]))"
)
NUMBER = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
STRING_PART = re.compile(rb"[^\\()]+|\\(?:\r\n|[0-7]{1,3}|[\s\S])|[()]")
IMAGE_END = re.compile(rb"(?<=[" + WHITE + rb"])EI(?=[" + WHITE + DELIMITERS + rb"]|\Z)")
NAME_PART = re.compile(rb"#([0-9A-Fa-f]{2})")
#: Tokens that leave a task at once.
MOST_TOKENS = 10_000


def _string(data: bytes, at: int) -> tuple[int, bytes]:
    """End and value of the string whose bracket stands before ``at``."""
    depth, out = 1, []
    while part := STRING_PART.match(data, at):
        at, got = part.end(), part[0]
        if got == b"(":
            depth += 1
        elif got == b")":
            depth -= 1
            if not depth:
                break
        elif got[:1] == b"\\":
            code = got[1:]
            # a line break behind a backslash is none
            got = b"" if code[:1] in b"\r\n" else bytes([int(code, 8) & 255]) if code[:1] in b"01234567" else LETTERS.get(code, code)
        out.append(got)
    else:
        at = len(data)  # a lone backslash at the end
    return at, b"".join(out)


def _image(data: bytes, at: int) -> int:
    """End of the inline image whose BI ends at ``at``."""
    begin = data.find(b"ID", at)
    begin = len(data) if begin < 0 else begin + 2
    end = IMAGE_END.search(data, begin + (data[begin : begin + 1] != b"" and data[begin] in b"\x00\t\n\x0c\r "))
    return end.end() if end else len(data)


def tokens(data: bytes) -> Iterator[tuple[str, int, int, bytes, float | None]]:
    """``(kind, start, end, value, number)`` of each token: name, string, hex, number, open, close, operator or image; comments and stray > are left out.

    value: a name without its slash and with its #xx as bytes, a string's bytes, else the token as it stands. What begins like a number is one, as far as it can be read.
    """
    at = 0
    while found := TOKEN.match(data, at):
        kind = found.lastgroup
        if kind == "stray":
            at = found.end()
            continue
        start, at, value, number = found.start(kind), found.end(), found[kind], None
        if kind == "name":
            value = NAME_PART.sub(lambda m: bytes([int(m[1], 16)]), value[1:])
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", value)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "string":
            at, value = _string(data, at)
        elif kind == "word":
            read = NUMBER.match(value) if value[:1] in b"+-.0123456789" else None
            kind = "number" if read else "operator"
            number = float(read[0]) if read else None
            if value == b"BI":
                at, kind = _image(data, at), "image"
                value = data[start:at]
        elif kind == "mark":
            kind = "operator"
        yield kind, start, at, value, number


def lexed(streams: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(<keep>, n, kind, start, end, value, number)``: the tokens of each row's ``content`` (binary), numbered from 0; null and empty streams have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.float64())
        for batch in batches:
            at, out = [], []
            for row in range(batch.num_rows):
                own = [(n, *t) for n, t in enumerate(tokens(batch.column(len(keep))[row].as_py() or b""))]
                at += [row] * len(own)
                out += own
                # streams are short and many, so they leave together
                if out and (len(out) >= MOST_TOKENS or row == batch.num_rows - 1):
                    keys = batch.select(list(keep)).take(pa.array(at)).columns
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=[*keep, "n", "kind", "start", "end", "value", "number"])
                    at, out = [], []

    rows = streams.select(*keep, streams[content].cast("binary"))
    schema = StructType(rows.schema.fields[:-1])
    for name, kind in (("n", LongType()), ("kind", StringType()), ("start", LongType()), ("end", LongType()), ("value", BinaryType()), ("number", DoubleType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
