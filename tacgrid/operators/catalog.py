"""What a library holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def maps(recordings: DataFrame, rounds: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Recordings and states of each map."""
    states = snapshots.groupBy("round_id").agg(F.count("*").alias("n"))
    per = rounds.join(states, "round_id", "left").groupBy("recording_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return recordings.join(per, "recording_id", "left").groupBy("map_id").agg(F.count_distinct("recording_id").alias("n_recordings"), F.sum(F.coalesce("n", F.lit(0))).alias("n_states"))


def team_names(recordings: DataFrame) -> DataFrame:
    """The names of all teams, once each, without case sorted first."""
    names = recordings.select(F.col("team_a").alias("team")).union(recordings.select("team_b")).where("team IS NOT NULL AND trim(team) <> ''")
    return names.distinct().orderBy(F.lower("team"), "team")


def with_rounds(recordings: DataFrame, rounds: DataFrame) -> DataFrame:
    """Recordings and n_rounds, 0 for none."""
    counts = rounds.groupBy("recording_id").agg(F.count("*").alias("n_rounds"))
    return recordings.join(counts, "recording_id", "left").withColumn("n_rounds", F.coalesce("n_rounds", F.lit(0)))


def counts(recordings: DataFrame, rounds: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: how many recordings, rounds and states there are."""
    each = {"recordings": recordings, "rounds": rounds, "states": snapshots}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in each.items()]
    return rows[0].union(rows[1]).union(rows[2]).agg(*(F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in each))


def summary(recordings: DataFrame, rounds: DataFrame, snapshots: DataFrame) -> dict[str, int]:
    return counts(recordings, rounds, snapshots).first().asDict()


def extend_registry(registry: DataFrame, names: DataFrame) -> DataFrame:
    """registry (name, id) and the new names of names, numbered on in order of the name. A registry is a list of names: one partition numbers it."""
    fresh = names.select("name").where("name IS NOT NULL").distinct().join(registry.select("name"), "name", "left_anti")
    last = registry.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name"))
    numbered = fresh.withColumn("n", number).crossJoin(last)  # one row
    return registry.select("name", "id").union(numbered.select("name", (F.col("last") + F.col("n")).cast("int")))


def remap(rows: DataFrame, local: DataFrame, registry: DataFrame, column: str) -> DataFrame:
    """rows (recording_id, <column>) with a recording's own numbers replaced by the registry's; unknown numbers stay.

    local: recording_id, idx, name.
    """
    table = local.join(registry, "name").select("recording_id", F.col("idx").alias(column), F.col("id").alias("_id"))
    return rows.join(table, ["recording_id", column], "left").withColumn(column, F.coalesce("_id", column)).select(*rows.columns)
