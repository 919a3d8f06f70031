"""From events to rounds, and from ticks to one row a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tacgrid import params as P


def build_rounds(freezes: DataFrame, ends: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """freezes (recording_id, tick, warmup), ends (recording_id, tick, winner, reason), starts (recording_id, tick) -> numbered valid rounds.

    Only ends that a side won count, and only what follows a recording's last start (none: all from tick 0). A round's
    freeze is the last one since the end before, or since the start, and before its own end. It counts if it lasted
    MIN_ROUND_SECONDS or more. Freezes of the warm-up don't count (null: not one). Of several ends at a tick the first by
    winner and reason counts.
    """

    def with_start(own: DataFrame) -> DataFrame:
        if starts is None:
            return own.withColumn("_start", F.lit(0).cast("long"))
        last = starts.groupBy("recording_id").agg(F.max("tick").alias("_start"))
        return own.join(last, "recording_id", "left").withColumn("_start", F.coalesce("_start", F.lit(0)))

    live = freezes.where(~F.coalesce("warmup", F.lit(False))).select("recording_id", F.col("tick").alias("freeze"))
    won = with_start(ends).where(F.col("winner").isin("CT", "T") & (F.col("tick") > F.col("_start")))
    w = Window.partitionBy("recording_id").orderBy("tick", "winner", "reason")
    known = won.withColumn("before", F.coalesce(F.lag("tick").over(w), F.col("_start")))
    pairs = known.join(live, "recording_id").where((F.col("freeze") >= F.col("before")) & (F.col("freeze") < F.col("tick")))
    found = pairs.groupBy("recording_id", F.col("tick").alias("end_tick"), "winner", "reason").agg(F.max("freeze").alias("freeze"))
    valid = found.where(F.col("end_tick") - F.col("freeze") >= P.MIN_ROUND_SECONDS * P.TICKRATE)
    number = F.row_number().over(Window.partitionBy("recording_id").orderBy("end_tick")).cast("int")
    return valid.withColumn("round_no", number).withColumn("is_pistol", F.col("round_no").isin(*P.PISTOL_ROUNDS))


def attach_round(events: DataFrame, rounds: DataFrame, by: list[str], inclusive: bool = True) -> DataFrame:
    """The round that an event falls in: the last freeze up to it, if the round hasn't ended. Equal events stay as many.

    Events at a round's last tick belong to it; samples (inclusive=False) don't. by: the equal columns, such as the recording,
    of which there is one at least. Rounds don't overlap but for one tick, so looking ahead to the next freeze is a window over rounds alone.
    """
    following = F.lead("freeze").over(Window.partitionBy(*by).orderBy("freeze"))
    known = rounds.withColumn("_next", following)
    upto = F.col("tick") <= F.col("end_tick") if inclusive else F.col("tick") < F.col("end_tick")
    between = (F.col("tick") >= F.col("freeze")) & upto & (F.col("_next").isNull() | (F.col("tick") < F.col("_next")))
    return events.join(known, by).where(between).drop("_next")


def attach_plants(plants: DataFrame, rounds: DataFrame) -> DataFrame:
    """(round_id, plant_tick, site): the first plant in event order of each round. plants: recording_id, tick, zone, event_no."""
    from tacgrid.functions.scalar import site_of

    pairs = plants.join(rounds, "recording_id").where(F.col("tick").between(F.col("freeze"), F.col("end_tick")))
    first = F.row_number().over(Window.partitionBy("round_id").orderBy("event_no"))
    return pairs.withColumn("_n", first).where("_n = 1").select("round_id", F.col("tick").alias("plant_tick"), site_of(F.col("zone")).alias("site"))


def buy_ticks(rounds: DataFrame) -> DataFrame:
    """(round_id, tick): the buy tick of each round, as on its grid."""
    return rounds.where("end_tick > freeze").select("round_id", F.least(F.col("freeze") + P.BUY_EVAL_SECONDS * P.TICKRATE, F.col("end_tick") - 1).alias("tick"))


def sample_grid(rounds: DataFrame) -> DataFrame:
    """(round_id, tick, is_buy): a tick each second from the freeze to before the end, and the buy tick."""
    buy = F.least(F.col("freeze") + P.BUY_EVAL_SECONDS * P.TICKRATE, F.col("end_tick") - 1)
    seconds = F.sequence(F.col("freeze"), F.col("end_tick") - 1, F.lit(P.TICKRATE).cast("long"))
    ticks = F.explode(F.array_distinct(F.concat(seconds, F.array(buy))))
    return rounds.where("end_tick > freeze").select("round_id", ticks.alias("tick"), buy.alias("buy")).select("round_id", "tick", (F.col("tick") == F.col("buy")).alias("is_buy"))


def resample(ticks: DataFrame, rounds: DataFrame) -> DataFrame:
    """The decoded ticks (round_id, tick, ...) that lie on the grid; none is made up."""
    return ticks.join(sample_grid(rounds), ["round_id", "tick"])


def carry_forward(samples: DataFrame, plants: DataFrame | None = None) -> DataFrame:
    """samples (round_id, tick, carrier_x, carrier_y) and bomb_x, bomb_y: the last known place; the plant's once planted.

    plants: round_id, plant_tick, plant_x, plant_y; a plant without a place doesn't override.
    """
    w = Window.partitionBy("round_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    found = samples.withColumn("bomb_x", last("carrier_x")).withColumn("bomb_y", last("carrier_y"))
    if plants is None:
        return found
    down = (F.col("tick") >= F.col("plant_tick")) & F.col("plant_x").isNotNull()
    own = lambda c: F.when(down, F.col(f"plant_{c}")).otherwise(F.col(f"bomb_{c}")).alias(f"bomb_{c}")
    return found.join(plants, "round_id", "left").select(*samples.columns, own("x"), own("y"))


def backfill_reasons(rounds: DataFrame, ends: DataFrame) -> DataFrame:
    """rounds (recording_id, end_tick, win_reason, ...) with missing reasons from ends (recording_id, tick, reason).

    Only the end at the round's own tick counts; reasons that aren't known are none. Of several the first by name.
    """
    from tacgrid.functions.scalar import reason_of

    known = ends.select("recording_id", F.col("tick").alias("end_tick"), reason_of(F.col("reason")).alias("_reason")).where("_reason IS NOT NULL")
    known = known.groupBy("recording_id", "end_tick").agg(F.min("_reason").alias("_reason"))
    return rounds.join(known, ["recording_id", "end_tick"], "left").withColumn("win_reason", F.coalesce("win_reason", "_reason")).select(*rounds.columns)


def equipment(samples: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """(round_id, side, equip) at the buy tick. samples: round_id, tick, side, value; without a grid they are those of buy ticks alone."""
    if grid is None:
        return samples.groupBy("round_id", "side").agg(F.sum("value").alias("equip"))
    at = grid.where("is_buy").select("round_id", "tick")
    return samples.join(at, ["round_id", "tick"]).groupBy("round_id", "side").agg(F.sum("value").alias("equip"))


def shots(fire: DataFrame, rounds: DataFrame, slots: DataFrame) -> DataFrame:
    """(round_id, shots): (tick since the freeze, slot) of each shot, in order. fire: recording_id, tick, player, weapon.

    Throws, knives and the bomb aren't shots; shooters outside the roster and offsets over 65,535 are left out.
    """
    gun = F.regexp_replace(F.coalesce("weapon", F.lit("")), "^weapon_", "")
    guns = fire.where(~gun.isin(*P.NO_SHOT) & ~gun.contains("knife") & ~gun.contains("bayonet"))
    placed = attach_round(guns.join(slots, ["recording_id", "player"]), rounds, ["recording_id"]).withColumn("rel", F.col("tick") - F.col("freeze"))
    return placed.where(F.col("rel").between(0, 65535)).groupBy("round_id").agg(F.sort_array(F.collect_list(F.struct("rel", "slot"))).alias("shots"))


def number_parts(rounds: DataFrame) -> DataFrame:
    """Round numbers across the parts of a recording, and pistol flags by them.

    rounds: round_id, recording_id, round_no, prefix, part, map_id, day (of <prefix>-p<part>). Parts go together by prefix,
    map and day, in order of part, then recording. Rounds without a prefix stay as they are.
    """
    w = Window.partitionBy("prefix", "map_id", "day").orderBy("part", "recording_id", "round_no")
    number = F.when(F.col("prefix").isNotNull(), F.row_number().over(w)).otherwise(F.col("round_no")).cast("int")
    return rounds.withColumn("match_round", number).withColumn("is_pistol", F.col("match_round").isin(*P.PISTOL_ROUNDS))
