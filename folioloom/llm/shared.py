"""Tables that cut lineage, and joins with a small side of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Most rows of a table that is broadcast; more rows are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Most pairs of numbers (32 bytes each) that are broadcast, and members that share one copy of their centre's text.
BROADCAST_PAIRS, PART_ROWS = 200_000, 256
#: Rows and bytes of an Arrow batch of whole texts, which stands in the JVM's and in Python's memory at once.
BATCH_ROWS, BATCH_BYTES = "1000", "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only on a single machine where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.folioloom.shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioloom-")
        spark.conf.set("spark.folioloom.shared", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later plans start from it, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioloom_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes at most for what runs inside; the session's settings come back after it."""
    arrow = "spark.sql.execution.arrow."
    wanted = {arrow + "maxRecordsPerBatch": BATCH_ROWS, arrow + "maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_folioloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with each text as zstandard bytes, so that a shuffle of whole texts writes about half."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else pack.compress(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, pa.binary()))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``packed`` made, with each text as its bytes."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else unpack.decompress(t) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, "text", pa.array(texts, pa.binary()))


def beside_centres(pairs: DataFrame, texts: DataFrame, *carried: str, part: int = PART_ROWS) -> DataFrame:
    """``(centre, salt, member, <carried>, text)``, text as ``packed`` gives it, of ``pairs (a, b, ..)``: in each task a row of the centre b (member null), then its members a.

    So a centre's text is sent once for each ``part`` members, not once a pair, and no task holds a centre's members: they pass by.
    texts: ``(doc_id, text)``.
    """
    per = pairs.groupBy("b").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    own = pairs.join(per, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    small = F.broadcast if few else (lambda df: df)
    members = texts.join(small(own.select(F.col("a").alias("doc_id"), F.col("b").alias("centre"), "salt", *carried)), "doc_id")
    members = members.select("centre", "salt", F.col("doc_id").alias("member"), *carried, "text")
    heads = per.select(F.col("b").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    heads = texts.join(small(heads), "doc_id").select(F.col("doc_id").alias("centre"), "salt", F.lit(None).cast("long").alias("member"), *(F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in carried), "text")
    # unlike a join, this sort by centre needs no row of a group beside another
    rows = heads.unionByName(members)
    rows = rows.mapInArrow(packed, StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in rows.schema]))
    return rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.col("member").asc_nulls_first())


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``rows`` rows (counted without reading past that), else as it is."""
    few = small.limit(rows + 1).count() <= rows
    return F.broadcast(small) if few else small
