"""Helpers shared by the corpus operators: reading, Arrow kernels, cutting lineage, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

#: Rows handed to a Python worker at once; texts can be long, so batches are kept short.
ROWS_PER_BATCH = 256
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Most rows of a side that is broadcast after it has been counted.
BROADCAST_ROWS = 200_000
#: A sieve has eight bits for each of its numbers, but not over 16 MB in all; a page is what bitmap_construct_agg holds.
SIEVE_BITS, PAGE_BITS = 1 << 27, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one if all runs in one process (tests), else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = f"file://{tempfile.mkdtemp(prefix='tacgrid-')}"
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def materialise(df: DataFrame, name: str, rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    rows_per_batch holds while it is written; more than the default suits narrow rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows_per_batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    df.sparkSession.conf.set(BATCH, str(ROWS_PER_BATCH))
    return df.mapInArrow(kernel, schema)


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def plainly(df: DataFrame) -> DataFrame:
    """df with column names that Arrow functions can take: no dots or backticks, none twice."""
    names: list[str] = []
    for c in df.columns:
        c = c.replace(".", "_").replace("`", "_")
        while c.lower() in (n.lower() for n in names) or (c not in df.columns and c.lower() in (n.lower() for n in df.columns)):
            c = "_" + c
        names.append(c)
    return df.toDF(*names)


def ids(df: DataFrame, name: str = "doc_id") -> Column:
    """The whole numbers that name df's rows, as longs; ValueError for another type."""
    kind = df.schema[name].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"{name}: whole numbers are asked for, not {kind.simpleString()}")
    return F.col(name).cast("long").alias(name)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunked(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about limit bytes together, one item at least."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def blobs(parts: list[np.ndarray]) -> pa.Array:
    """Numpy arrays as an Arrow binary column."""
    return pa.array([p.tobytes() for p in parts], pa.binary())


def bucket_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which Spark can split a hot key of the left side at run time.

    An aggregate on the right would lend its own partitioning to the join, and then Spark splits nothing.
    The further key, a hash of the keys, is no part of that partitioning: both sides get exchanges of the join's own.
    """
    extra = "_join_hash"
    mark = F.hash(*keys)
    return left.withColumn(extra, mark).join(right.withColumn(extra, mark), [*keys, extra], how).drop(extra)


def sieve_slot(number: Column, bits: int) -> Column:
    """The bit of a number, or of null."""
    return F.pmod(F.xxhash64(number), F.lit(bits))


def sieve(numbers: DataFrame) -> tuple[DataFrame, int]:
    """numbers (one long column, written before: it is read twice) -> (page, bits) with the bit set of every number and of null if it is there; how many bits there are."""
    n = numbers.count()
    bits = min(SIEVE_BITS, max(PAGE_BITS, 1 << (8 * n).bit_length()))
    slots = numbers.select(sieve_slot(F.col(numbers.columns[0]), bits).alias("slot"))
    page = F.expr(f"slot DIV {PAGE_BITS}").alias("page")
    return slots.groupBy(page).agg(F.bitmap_construct_agg(F.col("slot") % PAGE_BITS).alias("bits")), bits


def sift(df: DataFrame, number: Column, made: tuple[DataFrame, int]) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose number may be one of a sieve's, and those whose number surely isn't; no row is moved.

    The sieve is broadcast; it is bounded by SIEVE_BITS. With many more numbers than bits all rows may be there, and what
    follows takes them all: it is a shortcut, never the decision.
    """
    pages, bits = made
    slot, page, held = (unused(df, name) for name in ("_slot", "_page", "_held"))
    known = df.withColumn(slot, sieve_slot(number, bits))
    joined = known.join(F.broadcast(pages.toDF(page, held)), F.expr(f"{slot} DIV {PAGE_BITS}") == F.col(page), "left")
    at = F.expr(f"CAST({slot} % {PAGE_BITS} AS INT)")
    byte = F.conv(F.hex(F.substr(F.col(held), F.expr(f"CAST({slot} % {PAGE_BITS} DIV 8 AS INT) + 1"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    return joined.where(there).select(*every(df)), joined.where(~there).select(*every(df))
