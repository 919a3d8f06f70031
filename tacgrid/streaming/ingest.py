"""Incremental ingest as a stream of files; an extension, what it computes equals the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tacgrid import params as P


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Decoded rows of files as they arrive below folder."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def run_once(rows: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived since the last call, in batches through sink(batch, number)."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moment_sessions(matches: DataFrame, gap: int = P.MOMENT_GAP_S, late: str = "1 minute") -> DataFrame:
    """Streamed matches (round_id, ts, state_id, score) -> sessions of at most gap seconds between matches.

    A session of Spark ends gap after its last row and takes in a row at that very time, as a run of moments does.
    """
    w = F.session_window("ts", f"{gap} seconds")
    out = matches.withWatermark("ts", late).groupBy("round_id", w.alias("w")).agg(F.min("score").alias("score"), F.count("*").alias("n_states"), F.max("ts").alias("t_end"))
    return out.select("round_id", F.col("w.start").alias("t_start"), "t_end", "score", "n_states")
