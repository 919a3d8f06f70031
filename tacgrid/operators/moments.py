"""Runs of matching seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tacgrid import params as P


def islands(found: DataFrame, gap: int = P.MOMENT_GAP_S) -> DataFrame:
    """found (round_id, sec, state_id, ...) and island: numbered from 0 in each round, a new one after more than gap seconds."""
    w = Window.partitionBy("round_id").orderBy("sec", "state_id")
    new = F.coalesce((F.col("sec") - F.lag("sec").over(w) > gap).cast("int"), F.lit(0))
    return found.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def moments(found: DataFrame, gap: int = P.MOMENT_GAP_S) -> DataFrame:
    """found (round_id, sec, state_id, score, cost) -> one row for each run: its ends, best score, first best state, least cost."""
    best = F.min(F.struct("score", "sec", "state_id"))
    runs = islands(found, gap).groupBy("round_id", "island").agg(F.min("sec").alias("t_start"), F.max("sec").alias("t_end"), best.alias("b"), F.min("cost").alias("node_cost"), F.count("*").alias("n_states"))
    return runs.select("round_id", "t_start", "t_end", F.col("b.score").alias("score"), F.col("b.state_id").alias("state_id"), "node_cost", "n_states", (F.col("node_cost") <= P.EXACT).alias("exact"))


def ranked(runs: DataFrame, limit: int = P.DEFAULT_LIMIT) -> DataFrame:
    """Exact ones first, then by score, longer first, then by place. limit is 1 or more."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return runs.orderBy(F.desc("exact"), "score", F.desc(F.col("t_end") - F.col("t_start")), "round_id", "t_start").limit(limit)
