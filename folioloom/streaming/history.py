"""Edit histories with undo and redo, and a counter over files: one fold for a finished log and for a stream that keeps its state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class History:
    """Values of an object's edits and how many of them hold; an edit after an undo cuts off what could be done again."""

    def __init__(self, values: Iterable[str] = (), held: int = 0, seq: int | None = None) -> None:
        self.values, self.held, self.seq = list(values), held, seq

    def take(self, seq: int, op: str, value: str | None) -> None:
        if op == "undo":
            self.held = max(0, self.held - 1)
        elif op == "redo":
            self.held = min(len(self.values), self.held + 1)
        else:
            del self.values[self.held :]
            self.values.append(value)
            self.held += 1
        self.seq = seq

    def row(self) -> tuple:
        """(seq, value, n_edits, can_undo, can_redo); an object without edits that hold has a null value."""
        return self.seq, self.values[self.held - 1] if self.held else None, self.held, self.held > 0, self.held < len(self.values)


def replayed(log: DataFrame, object_: str, seq: str, op: str, value: str) -> DataFrame:
    """``(object_, seq, value, n_edits, can_undo, can_redo)``: where each object of a finished log stands; op is undo, redo, or else an edit to ``value``.

    Objects' operations pass a task in order of seq, and an object's values are held only while it passes. Undo and redo beyond the ends do nothing. Rows without object are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["o", "seq", "value", "n_edits", "can_undo", "can_redo"])

        for batch in batches:
            for key, at, what, said in zip(*(c.to_pylist() for c in batch.columns)):
                if key != own:
                    if state:
                        out.append((own, *state.row()))
                    own, state = key, History()
                state.take(at, what, said)
            if len(out) > 10_000:
                yield flush()
                out = []
        if state:
            out.append((own, *state.row()))
        yield flush()

    rows = log.where(F.col(object_).isNotNull()).select(F.col(object_).cast("long").alias("o"), F.col(seq).cast("long").alias("at"), F.col(op).alias("what"), F.col(value).cast("string").alias("said"))
    found = rows.repartition("o").sortWithinPartitions("o", "at").mapInArrow(run, "o long, seq long, value string, n_edits long, can_undo boolean, can_redo boolean")
    return found.withColumnRenamed("o", object_)


def history(stream: DataFrame, object_: str, seq: str, op: str, value: str) -> DataFrame:
    """The same over a stream, in update mode: a row for each object that a batch touches. The state of an object is its values and how many hold, so any batch may undo what earlier ones did.

    Operations of one batch are taken by seq; one that comes in a later batch than its successors is taken when it comes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = History(*state.get) if state.exists else History()
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for at, what, said in zip(rows["at"].tolist(), rows["what"], rows["said"]):
            own.take(at, what, said)
        state.update((own.values, own.held, own.seq))
        yield pd.DataFrame([(key[0], *own.row())], columns=[object_, "seq", "value", "n_edits", "can_undo", "can_redo"])

    rows = stream.select(F.col(object_).cast("long").alias(object_), F.col(seq).cast("long").alias("at"), F.col(op).alias("what"), F.col(value).cast("string").alias("said"))
    return rows.groupBy(object_).applyInPandasWithState(step, f"{object_} long, seq long, value string, n_edits long, can_undo boolean, can_redo boolean", "values array<string>, held long, seq long", "update", GroupStateTimeout.NoTimeout)


def numbered(stream: DataFrame, job: str, file: str, page: str, first: int = 1) -> DataFrame:
    """A stream's pages ``(job, file, page)`` with number, a count that goes on over the files of a job: by file and page within a batch, behind all of earlier batches. The state of a job is one number."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_ = state.get[0] if state.exists else first
        rows = pd.concat(list(frames)).sort_values([file, page], kind="stable")
        rows["number"] = range(next_, next_ + len(rows))
        state.update((next_ + len(rows),))
        yield rows[[job, file, page, "number"]]

    rows = stream.select(job, file, page)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(job).applyInPandasWithState(step, f"{kinds}, number long", "next long", "append", GroupStateTimeout.NoTimeout)
