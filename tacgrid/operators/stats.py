"""Statistics of the rounds that a search matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tacgrid import params as P


def representatives(states: DataFrame) -> DataFrame:
    """The earliest matching state of each round, by state_id."""
    return states.groupBy("round_id").agg(F.min_by(F.struct("sec", "planted"), "state_id").alias("r"), F.min("state_id").alias("state_id")).select("round_id", "state_id", "r.sec", "r.planted")


def round_counts(states: DataFrame, rounds: DataFrame) -> DataFrame:
    """states (round_id, in_match, in_exact, in_baseline) -> one row: rounds and wins of each population.

    close: rounds that match but not exactly. n_recordings: those of all matched rounds. Unknown winners win for none.
    """
    flags = states.groupBy("round_id").agg(F.max("in_match").alias("m"), F.max("in_exact").alias("e"), F.max("in_baseline").alias("b"))
    own = flags.join(rounds, "round_id")
    out = [F.count_distinct(F.when(F.col("m"), F.col("recording_id"))).alias("n_recordings")]
    for name, c in (("exact", F.col("e")), ("close", F.col("m") & ~F.col("e")), ("baseline", F.col("b"))):
        out += [F.count_if(c).alias(f"{name}_rounds"), F.count_if(c & (F.col("winner") == "CT")).alias(f"{name}_ct"), F.count_if(c & (F.col("winner") == "T")).alias(f"{name}_t")]
    return own.agg(*out)


def timing(states: DataFrame) -> DataFrame:
    """(bin, n): rounds with a match in each bin of the clock before the plant, the last bin open; bin -1: rounds after it."""
    bins = F.when(F.col("planted"), -1).otherwise(F.least(F.floor(F.col("sec") / P.HISTOGRAM_BIN_S), F.lit(P.HISTOGRAM_BINS - 1))).cast("int")
    found = states.select("round_id", bins.alias("bin")).distinct().groupBy("bin").agg(F.count("*").alias("n"))
    every = states.sparkSession.range(-1, P.HISTOGRAM_BINS).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _sides(columns: dict[str, F.Column]) -> F.Column:
    return F.explode(F.array(*(F.struct(F.lit(side).alias("side"), c.alias("value")) for side, c in columns.items())))


def filled(counts: DataFrame, values: dict[str, tuple[str, ...]], name: str) -> DataFrame:
    """counts (side, name, n) with zeros for the values that aren't there."""
    every = counts.sparkSession.createDataFrame([(s, v) for s, own in values.items() for v in own], f"side string, {name} string")
    return F.broadcast(every).join(counts, ["side", name], "left").select("side", name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def economy(rounds: DataFrame) -> DataFrame:
    """rounds (ct_buy, t_buy) matched -> (side, buy, n)."""
    each = rounds.select(_sides({"CT": F.col("ct_buy"), "T": F.col("t_buy")}).alias("s")).groupBy("s.side", F.col("s.value").alias("buy")).agg(F.count("*").alias("n"))
    return filled(each, {"CT": P.BUYS, "T": P.BUYS}, "buy")


def win_reasons(rounds: DataFrame) -> DataFrame:
    """rounds (winner, win_reason) -> (side, reason, n); a reason that isn't the winner's own counts as unknown."""
    own = F.when(F.col("winner") == "CT", F.col("win_reason").isin(*P.CT_REASONS)).otherwise(F.col("win_reason").isin(*P.T_REASONS))
    each = rounds.where("winner IS NOT NULL").select(F.col("winner").alias("side"), F.when(own, F.col("win_reason")).otherwise("unknown").alias("reason"))
    return filled(each.groupBy("side", "reason").agg(F.count("*").alias("n")), {"CT": (*P.CT_REASONS, "unknown"), "T": (*P.T_REASONS, "unknown")}, "reason")


def top_teams(rounds: DataFrame, n: int = 3) -> DataFrame:
    """rounds (round_id, ct_team, t_team) -> the n teams with the most rounds on each side; ties: the one with the first round."""
    each = rounds.select("round_id", _sides({"CT": F.col("ct_team"), "T": F.col("t_team")}).alias("s")).where("s.value IS NOT NULL").groupBy("s.side", F.col("s.value").alias("team")).agg(F.count("*").alias("n"), F.min("round_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("n"), "first", "team"))
    return each.withColumn("place", place.cast("int")).where(F.col("place") <= n).select("side", "place", "team", "n")


def next_kills(anchors: DataFrame, kills: DataFrame) -> DataFrame:
    """anchors (round_id, sec), kills (kill_id, round_id, round_sec, tick, victim_side) -> one row: who got the next kill, and when.

    The first kill after the anchor's second with a known side counts for the other side. seconds: median, truncated.
    """
    later = anchors.join(kills.where("victim_side IS NOT NULL").withColumnRenamed("sec", "_s").drop("_s"), "round_id").where("round_sec > sec")
    first = later.groupBy("round_id", "sec").agg(F.min(F.struct("tick", "kill_id", "victim_side", "round_sec")).alias("k"))
    every = anchors.join(first.select("round_id", "k"), "round_id", "left")
    wait = F.col("k.round_sec") - F.col("sec")
    return every.agg(
        F.count_if(F.col("k.victim_side") == "T").alias("ct"),
        F.count_if(F.col("k.victim_side") == "CT").alias("t"),
        F.count_if(F.col("k").isNull()).alias("none"),
        F.floor(F.percentile(wait, 0.5)).cast("long").alias("seconds"),
    )
