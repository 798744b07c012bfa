"""Long sequences in order over many tasks: no key's rows need to stand in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .shared import written


def in_order(rows: DataFrame, *order) -> DataFrame:
    """``rows`` in ranges of ``order``, sorted within; a key that leads the order may span several tasks."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def part() -> int:
    """The number of this task's range."""
    return TaskContext.get().partitionId()


def offsets(rows: DataFrame, key: str) -> DataFrame:
    """``(key, part, before)`` of ``rows (key, part, ..)``: the rows of the key in earlier parts, where there are any.

    A part holds at most one key that began before it, so there are fewer rows than parts, and they may be broadcast.
    """
    from pyspark.sql import Window

    sizes = rows.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("before", before).where("before > 0").select(key, "part", "before")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, seen, here = None, 0, part()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        at = np.arange(n, dtype=np.int64) - np.repeat(first, np.diff(np.r_[first, n]))
        if ids[0] == last:
            at[: first[1] if len(first) > 1 else n] += seen
        last, seen = ids[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, here, np.int32)), pa.array(at)], names=[*batch.schema.names, "part", "local"])


def numbered(rows: DataFrame, key: str, *order) -> DataFrame:
    """``rows`` with ``pos``, the place of a row among those of its key in the given order, from 1; key: a column of longs without nulls, the first one.

    Rows are dealt by range of key and order, numbered as they pass, and written; of keys that span ranges, earlier ranges' counts are added.
    """
    schema = StructType(rows.schema.fields).add("part", IntegerType()).add("local", LongType())
    placed = written(in_order(rows, key, *order).mapInArrow(_ranked, schema), "numbered")
    pos = (F.col("local") + F.coalesce("before", F.lit(0)) + 1).alias("pos")
    return placed.join(F.broadcast(offsets(placed, key)), [key, "part"], "left").select(*rows.columns, pos)
