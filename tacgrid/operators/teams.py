"""Teams known by cores of players."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tacgrid.functions.scalar import tidy_name, valid_player


def core_matches(round_players: DataFrame, members: DataFrame) -> DataFrame:
    """(round_id, side, core_id): all members of the core are on that side. round_players: round_id, pid, side; members: core_id, pid."""
    sizes = members.distinct().groupBy("core_id").agg(F.count("*").alias("size"))
    found = round_players.join(members.distinct(), "pid").groupBy("round_id", "side", "core_id").agg(F.count_distinct("pid").alias("n"))
    return found.join(sizes, "core_id").where("n = size").select("round_id", "side", "core_id")


def unique_matches(matches: DataFrame) -> DataFrame:
    """(round_id, side, core_id) where only one core matches the side."""
    return matches.groupBy("round_id", "side").agg(F.count("*").alias("n"), F.min("core_id").alias("core_id")).where("n = 1").drop("n")


def core_stats(matches: DataFrame, cores: DataFrame) -> DataFrame:
    """cores (core_id) -> rounds matched alone, and rounds in conflict with another core."""
    n = F.count("*").over(Window.partitionBy("round_id", "side"))
    sums = matches.withColumn("n", n).groupBy("core_id").agg(F.count_if(F.col("n") == 1).alias("matched"), F.count_if(F.col("n") > 1).alias("conflicts"))
    return cores.select("core_id").distinct().join(sums, "core_id", "left").select("core_id", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


def directory(appearances: DataFrame) -> DataFrame:
    """appearances (pid, name, seen_at, recording_id, slot) -> each player's latest name and number of recordings."""
    latest = F.max_by("name", F.struct("seen_at", "recording_id", F.negate("slot")))
    return appearances.groupBy("pid").agg(latest.alias("name"), F.count_distinct("recording_id").alias("n_recordings"))


def canonical(names: DataFrame, aliases: DataFrame, name: str = "team") -> DataFrame:
    """names with each alias replaced by its team's own name, whatever its case; aliases: alias, canonical (a list of names)."""
    known = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min("canonical").alias("_own"))
    joined = names.join(known, F.lower(F.col(name)) == F.col("_alias"), "left")
    return joined.withColumn(name, F.coalesce("_own", name)).select(*names.columns)


def check_core(name: str, players: list[str], known: DataFrame, cores: DataFrame, core_id: int | None = None, members: DataFrame | None = None) -> list[str]:
    """What is wrong with a core to be saved, told by one job; empty if nothing is. known: pid; cores: core_id, name; members: core_id, pid."""
    spark, wrong = known.sparkSession, []
    given = spark.createDataFrame([(name, list(players))], "name string, pids array<string>")
    allowed = known.select("pid") if core_id is None or members is None else known.select("pid").union(members.where(F.col("core_id") == core_id).select("pid"))
    pids = spark.createDataFrame([(p,) for p in players], "pid string")
    unknown = pids.join(allowed, "pid", "left_anti").agg(F.count("*"))
    own = F.col("core_id").eqNullSafe(F.lit(core_id)) if core_id is not None else F.lit(False)
    same = F.lower("name") == F.lower(F.coalesce(tidy_name(F.lit(name)), F.lit("")))
    counts = cores.agg(F.struct(F.count_if(own).alias("found"), F.count_if(~own & same).alias("taken")))
    told = given.select(tidy_name(F.col("name")).alias("clean"), F.forall("pids", valid_player).alias("valid"), unknown.scalar().alias("unknown"), counts.scalar().alias("c")).first()
    if told["clean"] is None:
        wrong.append("a name has 1 to 60 characters")
    if len(set(players)) != len(players) or not 3 <= len(players) <= 5:
        wrong.append("a core has 3 to 5 different players")
    if told["valid"] is False:
        wrong.append("a player's id has 17 digits")
    if told["unknown"]:
        wrong.append("a player isn't known")
    if core_id is not None and not told["c"]["found"]:
        wrong.append("there is no such core")
    if told["c"]["taken"]:
        wrong.append("the name is taken")
    return wrong
