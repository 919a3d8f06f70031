"""Recording files: discovery, fingerprints, new ones, parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tacgrid import params as P


def discover(spark: SparkSession, folder: str, suffix: str = ".dem") -> DataFrame:
    """(path, size, modified) of all files below folder with that ending. Contents aren't read; Spark leaves out empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def with_scheme(path: str) -> str:
    """A path as Spark writes it (file:/x, /x, hdfs://host/x) with a scheme and two slashes."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else f"file://{path}"


def arrow_uri(path: str) -> str:
    """A path of Spark's, which isn't escaped, as Arrow takes it."""
    return quote(with_scheme(path), safe="/:@")


def content_keys(spark: SparkSession, folder: str, suffix: str = ".dem") -> DataFrame:
    """(path, size, content_key, bytes_read): SHA-1 of the first FINGERPRINT_BYTES and the size; no more of a file is read.

    The executors read the heads through Arrow's file systems. A scheme that Arrow doesn't know goes through Spark's own
    reader, which takes in whole files.
    """
    found = discover(spark, folder, suffix)
    schema = "path string, size long, content_key string, bytes_read long"

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, size in zip(b["path"], b["size"], strict=True):
                fs, inner = pafs.FileSystem.from_uri(arrow_uri(path))
                with fs.open_input_file(inner) as f:
                    head = f.read_at(min(P.FINGERPRINT_BYTES, size), 0)
                rows.append((path, size, f"{hashlib.sha1(head).hexdigest()}:{size}", len(head)))
            yield pd.DataFrame(rows, columns=["path", "size", "content_key", "bytes_read"])

    try:
        pafs.FileSystem.from_uri(arrow_uri(folder))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
        key = F.concat(F.sha1(F.substring("content", 1, P.FINGERPRINT_BYTES)), F.lit(":"), F.col("length").cast("string"))
        return whole.select("path", F.col("length").alias("size"), key.alias("content_key"), F.col("length").alias("bytes_read"))
    return found.select("path", "size").mapInPandas(heads, schema)


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """found (path, content_key) without the keys of known; of equal keys the first by path."""
    first = F.row_number().over(Window.partitionBy("content_key").orderBy("path"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n").join(known.select("content_key"), "content_key", "left_anti")


def resolve(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (recording_id, name, size, content_key) -> path: a file of equal name and size; of several the one of equal content, else the first.

    Files are put down to the first by name and size, and by content too, so that a recording meets two of them however many there are.
    """
    first = lambda own, *keys: own.groupBy(*keys).agg(F.min(F.struct("path")).alias("file"))
    equal = first(files.where("content_key IS NOT NULL"), "name", "size", "content_key").withColumnRenamed("file", "equal")
    named = rows.join(first(files, "name", "size"), ["name", "size"]).join(equal, ["name", "size", "content_key"], "left")
    best = F.min(F.struct(F.col("equal").isNull().alias("other"), F.coalesce("equal", "file").alias("file"))).alias("b")
    return named.groupBy("recording_id").agg(best).select("recording_id", F.col("b.file.path").alias("path"))


def event_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A decoded event table, Parquet under folder/name; empty if there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def decode(files: DataFrame, decoder, schema: str) -> DataFrame:
    """files (path, ...) through decoder(path) -> pandas frame, a file at a time on the executors; for parsers of raw recordings."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                yield decoder(path)

    return files.select("path").mapInPandas(kernel, schema)
