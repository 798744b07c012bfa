"""Tables and files as DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder, so that rounds of joins do not repeat the plans before them."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.folioloom.staged", None)
    if not folder:  # unset only outside clusters, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioloom-")
        spark.conf.set("spark.folioloom.staged", folder)
    path = f"{folder.rstrip('/')}/folioloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, name, length, content)`` of binary files; the name is the path's last part."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """``(word)``: distinct lower-case words of two letters or more from a text file, a word a line."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).select(word.alias("word")).where(F.length("word") >= 2).where(F.col("word").rlike("^[a-z']+$")).distinct()


def is_image(name: F.Column, kind: F.Column | None = None) -> F.Column:
    """A name that ends like a PNG or JPEG file, or such a media type."""
    by_name = F.lower(name).rlike(r"\.(png|jpe?g)$")
    return by_name if kind is None else by_name | F.coalesce(kind.rlike(r"^image/(png|jpeg)$"), F.lit(False))


def is_jpeg(content: F.Column) -> F.Column:
    return F.coalesce(F.hex(F.substring(content, 1, 2)) == "FFD8", F.lit(False))
