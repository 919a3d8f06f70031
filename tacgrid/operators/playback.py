"""Match context of a round: parts of a recording, running score, kills so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tacgrid import params as P
from tacgrid.functions.scalar import lerp_yaw


def siblings(recordings: DataFrame) -> DataFrame:
    """(recording_id, match_id): parts with equal prefix, map and day (null days equal) are one match, known by its first part."""
    w = Window.partitionBy("prefix", "map_id", "day").orderBy("part", "recording_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return recordings.select("recording_id", F.when(F.col("prefix").isNotNull(), F.first("recording_id").over(w)).otherwise(F.col("recording_id")).alias("match_id"))


def running_score(rounds: DataFrame) -> DataFrame:
    """rounds (match_id, match_round, round_id, winner, ct_key, t_key) -> the score of both sides before each round.

    A side's score is that of its team in the match so far: wins are counted by team key, so they follow the team over
    half-time.
    """
    each = rounds.select("match_id", "match_round", "round_id", F.lower("winner").alias("won"), F.explode(F.array(F.struct(F.lit("ct").alias("side"), F.col("ct_key").alias("key")), F.struct(F.lit("t").alias("side"), F.col("t_key").alias("key")))).alias("s"))
    w = Window.partitionBy("match_id", "s.key").orderBy("match_round").rangeBetween(Window.unboundedPreceding, -1)
    sums = each.withColumn("n", F.coalesce(F.sum((F.col("won") == F.col("s.side")).cast("long")).over(w), F.lit(0)))
    own = lambda side: F.max(F.when(F.col("s.side") == side, F.col("n"))).alias(f"{side}_score")
    return sums.groupBy("round_id").agg(own("ct"), own("t"))


def tallies(kills: DataFrame) -> DataFrame:
    """kills (round_id, attacker, attacker_side, victim, victim_side, assister) -> (round_id, player, kills, deaths, assists).

    A kill of one's own side takes one away; a suicide is no kill.
    """
    each = _credits(kills.withColumn("round_sec", F.lit(0)))
    return each.groupBy("round_id", "player").agg(F.sum("k").alias("kills"), F.sum("d").alias("deaths"), F.sum("a").alias("assists"))


def tallies_before(each: DataFrame, rounds: DataFrame) -> DataFrame:
    """Sums over the earlier rounds of the match. each: round_id, player, kills ...; rounds: round_id, match_id, match_round."""
    rows = each.join(rounds, "round_id")
    w = Window.partitionBy("match_id", "player").orderBy("match_round").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("round_id", "player", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in ("kills", "deaths", "assists")))


def _credits(kills: DataFrame) -> DataFrame:
    """A row for each death, kill and assist: round_id, round_sec, player, k, d, a."""
    zero, one = F.lit(0), F.lit(1)
    points = F.when(F.col("attacker") == F.col("victim"), 0).when(F.col("attacker_side") == F.col("victim_side"), -1).otherwise(1)
    row = lambda who, k, d, a: F.struct(F.col(who).alias("player"), k.cast("long").alias("k"), d.cast("long").alias("d"), a.cast("long").alias("a"))
    each = F.array(row("victim", zero, one, zero), row("attacker", points, zero, zero), row("assister", zero, zero, one))
    return kills.select("round_id", "round_sec", F.explode(each).alias("r")).where("r.player IS NOT NULL").select("round_id", "round_sec", "r.*")


def live_tallies(kills: DataFrame, at: DataFrame) -> DataFrame:
    """Kills, deaths and assists in the round up to each moment, of those who have any by then. at: round_id, t.

    Credits and moments of a player are one stream in order of time, credits first, and the sums run along it: no moment
    meets a kill. A moment is there once for each player of the round who ever gets a credit; repeated moments count once.
    """
    credits = _credits(kills).withColumns({"at": F.col("round_sec"), "moment": F.lit(0)})
    players = credits.select("round_id", "player").distinct()
    zero = {c: F.lit(0).cast("long") for c in ("k", "d", "a")}
    moments = at.select("round_id", F.col("t").alias("at")).distinct().join(players, "round_id").withColumns({**zero, "moment": F.lit(1)})
    w = Window.partitionBy("round_id", "player").orderBy("at", "moment").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["round_id", "player", "at", "moment", "k", "d", "a"]
    run = credits.select(columns).union(moments.select(columns)).withColumn("n", F.sum(1 - F.col("moment")).over(w))
    sums = run.select("round_id", F.col("at").alias("t"), "player", "moment", "n", *(F.sum(c).over(w).alias(name) for c, name in (("k", "kills"), ("d", "deaths"), ("a", "assists"))))
    return sums.where("moment = 1 AND n > 0").drop("moment", "n")


def dead_at(kills: DataFrame, at: DataFrame) -> DataFrame:
    """(round_id, t, dead): who has died up to each moment that has a kill before it, in order of name.

    Kills and moments of a round are one stream in order of time; a set runs along it, no moment meets a kill.
    """
    moments = at.select("round_id", F.col("t").alias("at")).distinct().select("round_id", "at", F.lit(None).cast(kills.schema["victim"].dataType).alias("victim"), F.lit(1).alias("moment"))
    run = kills.select("round_id", F.col("round_sec").alias("at"), "victim", F.lit(0).alias("moment")).union(moments)
    w = Window.partitionBy("round_id").orderBy("at", "moment").rowsBetween(Window.unboundedPreceding, 0)
    seen = run.withColumns({"dead": F.sort_array(F.collect_set("victim").over(w)), "n": F.sum(1 - F.col("moment")).over(w)})
    return seen.where("moment = 1 AND n > 0").select("round_id", F.col("at").alias("t"), "dead")


def repair_sides(kills: DataFrame, frames: DataFrame) -> DataFrame:
    """kills with sides as each player's usual one in frames (round_id, player, side); who isn't seen there keeps the event's.

    Events at a round's very end can already carry the sides of the next.
    """
    from tacgrid.operators.roster import player_sides

    usual = player_sides(frames)
    out = kills
    for who in ("attacker", "victim"):
        own = usual.select("round_id", F.col("player").alias(who), F.col("side").alias("_side"))
        out = out.join(own, ["round_id", who], "left").withColumn(f"{who}_side", F.coalesce("_side", f"{who}_side")).drop("_side")
    return out.select(*kills.columns)


def tween(frames: DataFrame, per_second: int = 4) -> DataFrame:
    """frames (round_id, player, sec, x, y, yaw) -> positions between the seconds, linear, yaw along the shorter arc."""
    w = Window.partitionBy("round_id", "player").orderBy("sec")
    return between(frames.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("sec", "x", "y", "yaw"))), per_second)


def between(ahead: DataFrame, per_second: int = 4) -> DataFrame:
    """tween of frames that have their player's next one beside them (next_sec, next_x, next_y, next_yaw; null: the last)."""
    steps = lambda n: F.array(*map(F.lit, range(n)))
    each = ahead.withColumn("k", F.explode(F.when(F.col("next_sec").isNull(), steps(1)).otherwise(steps(per_second))))
    t = F.col("k") / per_second
    line = lambda c: F.coalesce(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * t, F.col(c)).alias(c)
    return each.select("round_id", "player", line("sec"), line("x"), line("y"), F.coalesce(lerp_yaw(F.col("yaw"), F.col("next_yaw"), t), F.col("yaw")).alias("yaw"))


def kill_feed(kills: DataFrame, at: DataFrame, last: int = 6, within: int = 8) -> DataFrame:
    """The last kills up to each moment, none older than within seconds. at: round_id, t; kills: round_id, kill_id, round_sec."""
    pairs = at.join(kills, "round_id").where((F.col("round_sec") <= F.col("t")) & (F.col("round_sec") > F.col("t") - within))
    place = F.row_number().over(Window.partitionBy("round_id", "t").orderBy(F.desc("round_sec"), F.desc("kill_id")))
    return pairs.withColumn("place", place.cast("int")).where(F.col("place") <= last)


def carrier(players: DataFrame, bombs: DataFrame | None = None, reach: float = 40.0) -> DataFrame:
    """(state_id, slot): the nearest living T within reach of the bomb. players: state_id, slot, side, alive, x, y; bombs: state_id, bx, by.

    Without bombs, players have bx and by of their own. Who is near is settled in each player's row; only they meet.
    """
    living = players.where("alive AND side = 'T'")
    placed = living if bombs is None else living.join(bombs, "state_id")
    near = placed.withColumn("away", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).where(F.col("away") <= reach)
    return near.groupBy("state_id").agg(F.min(F.struct("away", "slot")).alias("b")).select("state_id", F.col("b.slot").alias("slot"))


def decode_shots(shots: DataFrame) -> DataFrame:
    """shots (round_id, shots) -> (round_id, seconds since the freeze to two places, slot)."""
    return shots.select("round_id", F.explode("shots").alias("s")).select("round_id", F.bround(F.col("s.rel") / P.TICKRATE, 2).alias("seconds"), "s.slot")
