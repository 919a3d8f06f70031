"""Line dedup: lines that several documents share stay only in the document with the smallest id.

Each text is split into lines; a line's key is hashed to 128 bits; one row per document and key goes through an
aggregation that tells how many documents hold the key and which comes first; keys over the threshold drop their lines
elsewhere; the kept lines are joined again by position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tacgrid.llm.base import as_bytes, ids, map_arrow, materialise, plainly, skew_join, table, unused

STRIP = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits of the stripped, lower-cased line; None if it is shorter than min_chars code points."""
    key = line.strip(STRIP).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2): one row for each document row and distinct key."""

    def kernel(batches):
        for b in batches:
            ids, keys, counts = b.column("doc_id"), [], []
            for text in as_bytes(b.column("text")):
                own = {k for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars)) is not None}
                keys += own
                counts.append(len(own))
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "h1", "h2"])

    return map_arrow(docs.where(F.col("doc_id").isNotNull()).select(ids(docs), "text"), kernel, "doc_id long, h1 long, h2 long")


def repeated_keys(keys: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, first): keys found in min_docs documents or more, and the smallest doc_id."""
    if min_docs <= 2:  # two documents hold it if the smallest and the largest id differ: no count of distinct ids is needed
        found = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    else:
        found = keys.distinct().groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return found.select("h1", "h2", "first")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) -> all its columns with text replaced, and n_lines, n_dropped.

    A null or empty text is one empty line; a null text stays null. Rows that share a doc_id count as one document. A row
    without a doc_id keeps all lines and counts for no key. Columns n_lines and n_dropped of the input are replaced.
    doc_id: whole numbers, ValueError for others.
    """
    given = docs.drop("n_lines", "n_dropped")
    docs = plainly(given)
    doc, gone_keys = unused(docs, "_doc"), unused(docs, "_drops")
    keys = materialise(line_keys(docs, min_chars), "line-keys")
    drops = (
        skew_join(keys, repeated_keys(keys, min_docs), ["h1", "h2"], "inner")
        .where("doc_id <> first")
        .groupBy(F.col("doc_id").alias(doc))
        .agg(F.collect_set(F.struct("h1", "h2")).alias(gone_keys))
    )
    joined = docs.join(drops, ids(docs) == F.col(doc), "left").drop(doc)
    names = docs.columns

    def kernel(batches):
        for b in batches:
            texts, lines_in, lines_out = [], [], []
            drops = b.column(gone_keys)
            flat = drops.flatten()
            halves = np.stack([np.asarray(flat.field(0)), np.asarray(flat.field(1))], 1).astype(np.int64) if len(flat) else np.zeros((0, 2), np.int64)
            sizes = np.cumsum([0, *pc.list_value_length(drops).fill_null(0).to_pylist()])
            raw = np.ascontiguousarray(halves).tobytes()
            for i, text in enumerate(as_bytes(b.column("text"))):
                gone = {raw[16 * k : 16 * k + 16] for k in range(sizes[i], sizes[i + 1])}
                lines = (text or b"").split(b"\n")
                kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                lines_in.append(len(lines))
                lines_out.append(len(lines) - len(kept))
                texts.append(text if text is None else b"\n".join(kept))
            out = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(lines_in, pa.int64()), pa.array(lines_out, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = StructType([*docs.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return map_arrow(joined, kernel, schema).toDF(*given.columns, "n_lines", "n_dropped")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, s.first IS NOT NULL AND s.first <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
