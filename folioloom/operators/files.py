"""Checksums, archives, times and ciphers of whole files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADER = 30  # bytes of a local file header without its name


def dos_time(at: Column) -> Column:
    """A time in an archive's 32 bits, in steps of two seconds, not before 1980."""
    date = F.shiftleft(F.greatest(F.year(at), F.lit(1980)) - 1980, 9) + F.shiftleft(F.month(at), 5) + F.dayofmonth(at)
    time = F.shiftleft(F.hour(at), 11) + F.shiftleft(F.minute(at), 5) + F.floor(F.second(at) / 2)
    return date.cast("long") * 65536 + time


def zip_offsets(entries: DataFrame, archive: str, order: str, name: str, size: Column) -> DataFrame:
    """``entries`` with offset: where each one's header begins in its archive, all stored as they are."""
    length = F.lit(HEADER) + F.octet_length(F.encode(name, "UTF-8")) + size
    before = W.partitionBy(archive).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def encrypted(content: Column, key: Column, vector: Column) -> Column:
    """AES-CBC with padding; the vector stands before the cipher text."""
    return F.aes_encrypt(content, key, F.lit("CBC"), F.lit("PKCS"), vector)


def decrypted(content: Column, key: Column) -> Column:
    return F.aes_decrypt(content, key, F.lit("CBC"), F.lit("PKCS"))


def rc4(files: DataFrame, content: str, key: str) -> DataFrame:
    """``files`` with ``content`` under RC4 with each row's key (the same again turns it back); a null or empty key leaves it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf[content] = [_rc4(bytes(k), bytes(c)) if c is not None and k else c for k, c in zip(pdf[key], pdf[content])]
            yield pdf

    return files.mapInPandas(run, files.schema)


def _rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[n] = byte ^ box[(box[i] + box[j]) & 255]
    return bytes(out)
