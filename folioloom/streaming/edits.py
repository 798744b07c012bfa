"""An append-only log of edits: the latest of each object, undo by replay, and quiet periods; batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, object_: str, seq: str, upto: int | None = None) -> DataFrame:
    """The last edit of each object, of those up to ``upto``: undoing is replaying less. Partial maxima meet, so no object's log is gathered."""
    rows = log if upto is None else log.where(F.col(seq) <= upto)
    rest = F.struct(seq, *(c for c in log.columns if c not in (object_, seq)))
    return rows.groupBy(object_).agg(F.max_by(rest, seq).alias("_last")).select(object_, "_last.*")


def quiet_periods(events: DataFrame, user: str, at: str, gap: str = "2 minutes") -> DataFrame:
    """``(user, start, end, n)``: runs of events with less than ``gap`` between; for a stream, with a watermark on ``at``."""
    window = F.session_window(at, gap)
    return events.groupBy(user, window.alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def snapshots(stream: DataFrame, object_: str, seq: str, path: str, checkpoint: str):
    """A query that keeps the latest edits of a stream as Parquet, a folder a batch; the last folder is the state to recover."""

    def keep(batch: DataFrame, epoch: int) -> None:
        before = f"{path}/{epoch - 1}"
        old = batch.sparkSession.read.parquet(before) if epoch and _there(batch.sparkSession, before) else None
        latest(batch if old is None else old.unionByName(batch), object_, seq).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _there(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
