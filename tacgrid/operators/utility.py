"""Utility: what is active when, lifetimes of detonations, flight tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tacgrid import params as P


def active(snapshots: DataFrame, pieces: DataFrame, cap: int = P.MAX_ACTIVE_UTILITY) -> DataFrame:
    """snapshots (state_id, round_id, sec), pieces (util_id, round_id, kind, t_start, t_end, ...) -> pieces by state and kind.

    A piece is active from t_start to t_end, both included; without an end in its first second alone. Of a kind, the
    first cap by util_id count. The equi-join on the round bounds the pairs to those of one round.
    """
    pairs = snapshots.select("state_id", "round_id", "sec").join(pieces, "round_id").where(F.col("sec").between(F.col("t_start"), F.coalesce("t_end", "t_start")))
    w = Window.partitionBy("state_id", "kind").orderBy("util_id")
    return pairs.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= cap)


def active_lists(snapshots: DataFrame, pieces: DataFrame, fields: tuple[str, ...] = ("node", "x", "y"), cap: int = P.MAX_ACTIVE_UTILITY) -> DataFrame:
    """(state_id, smokes, mollies): lists of struct(slot, fields), the first cap by util_id; states without any are left out.

    A state's pieces are those of its round; they are gathered once, put in order and cut.
    """
    pairs = snapshots.select("state_id", "round_id", "sec").join(pieces, "round_id").where(F.col("sec").between(F.col("t_start"), F.coalesce("t_end", "t_start")) & F.col("kind").isin("smoke", "molly"))
    gathered = lambda kind: F.slice(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("util_id", *fields)))), 1, cap)
    numbered = lambda c: F.transform(c, lambda p, i: F.struct((i + 1).alias("slot"), *(p[f].alias(f) for f in fields))).alias(c)
    return pairs.groupBy("state_id").agg(gathered("smoke").alias("smokes"), gathered("molly").alias("mollies")).select("state_id", numbered("smokes"), numbered("mollies"))


def with_active(snapshots: DataFrame, pieces: DataFrame, fields: tuple[str, ...] = ("node", "x", "y"), cap: int = P.MAX_ACTIVE_UTILITY) -> DataFrame:
    """snapshots (round_id, sec, ...) with smokes and mollies as of active_lists, null in rounds without a piece, and n_smoke and n_molly, their lengths.

    The pieces of a round are gathered and meet its snapshots as one list, so nothing is grouped by snapshot.
    """
    piece = F.struct("util_id", F.col("t_start").alias("first"), F.coalesce("t_end", "t_start").alias("last"), *fields)
    kinds = {"smoke": "smokes", "molly": "mollies"}
    own = pieces.where(F.col("kind").isin(*kinds)).groupBy("round_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, piece))).alias(f"_{kind}") for kind in kinds))
    on = lambda p: (F.col("sec") >= p["first"]) & (F.col("sec") <= p["last"])
    numbered = lambda c: F.transform(F.slice(F.filter(c, on), 1, cap), lambda p, i: F.struct((i + 1).alias("slot"), *(p[f].alias(f) for f in fields)))
    length = lambda c: F.least(F.coalesce(F.size(F.filter(c, on)), F.lit(0)), F.lit(cap))
    found = {name: numbered(f"_{kind}") for kind, name in kinds.items()} | {f"n_{kind}": F.greatest(length(f"_{kind}"), F.lit(0)) for kind in kinds}
    return snapshots.join(own, "round_id", "left").withColumns(found).drop("_smoke", "_molly")


def lifetimes(detonations: DataFrame, expiries: DataFrame, rounds: DataFrame) -> DataFrame:
    """detonations (recording_id, util_id, entity_id, kind, tick), expiries (recording_id, entity_id, kind, tick) -> lifetimes.

    Gives util_id, round_id, kind, start_sec, end_sec.

    The first expiry of an entity counts, if it is later; else a kind's usual lifetime. The end is no later than the
    round's and no earlier than the start. Detonations outside rounds are left out. rounds: recording_id, round_id, freeze, end_tick.
    """
    from tacgrid.operators.rounds import attach_round

    keys = ["recording_id", "entity_id", "kind"]
    first = expiries.groupBy(*keys).agg(F.min("tick").alias("expire"))
    placed = attach_round(detonations, rounds.select("recording_id", "round_id", "freeze", "end_tick"), ["recording_id"]).join(first, keys, "left")
    usual = F.when(F.col("kind") == "smoke", P.SMOKE_FALLBACK_S).when(F.col("kind") == "molly", P.MOLLY_FALLBACK_S)
    end = F.when(F.col("expire") > F.col("tick"), F.col("expire")).otherwise(F.col("tick") + usual * P.TICKRATE)
    start_sec = F.greatest(F.lit(0), F.bround((F.col("tick") - F.col("freeze")) / P.TICKRATE).cast("int"))
    end_sec = F.bround((F.least(end, F.col("end_tick")) - F.col("freeze")) / P.TICKRATE).cast("int")
    return placed.select("util_id", "round_id", "kind", start_sec.alias("start_sec"), F.when(end.isNotNull(), F.greatest(start_sec, end_sec)).alias("end_sec"))


def sessions(samples: DataFrame, keys: list[str], gap: int = P.TRACK_GAP_TICKS) -> DataFrame:
    """samples (keys, tick, ...) and session: numbered from 0 for each key; a new one after more than gap ticks. One of a single sample is left out."""
    w = Window.partitionBy(*keys).orderBy("tick")
    new = F.coalesce((F.col("tick") - F.lag("tick").over(w) > gap).cast("int"), F.lit(0))
    found = samples.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")
    return found.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "session"))).where("_n >= 2").drop("_n")


#: Rows that matching gives out together.
MATCHES_AT_ONCE = 10_000


class LiveTracks:
    """Tracks in the air, by the cell of their last place; cells are as wide as a detonation reaches."""

    def __init__(self, reach: float) -> None:
        self.reach = reach
        self.cells: dict[tuple[int, int], set] = {}
        self.at: dict = {}  # track -> (its cell, x, y)
        self.points: dict = {}

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.reach), math.floor(y / self.reach)

    def drop(self, track) -> None:
        if track in self.at:
            cell = self.at.pop(track)[0]
            self.cells[cell].discard(track)
            if not self.cells[cell]:
                del self.cells[cell]

    def move(self, track, x: float, y: float) -> None:
        cell, before = self._cell(x, y), self.at.get(track)
        if before is None or before[0] != cell:
            self.drop(track)
            self.cells.setdefault(cell, set()).add(track)
        self.points[track] = self.points.get(track, 0) + 1
        self.at[track] = (cell, x, y)

    def nearest(self, x: float, y: float) -> tuple[float, object] | None:
        """(distance, track) of the nearest one of two points or more within reach; ties the lowest track."""
        cx, cy = self._cell(x, y)
        around = (t for dx in (-1, 0, 1) for dy in (-1, 0, 1) for t in self.cells.get((cx + dx, cy + dy), ()))
        found = ((math.hypot(self.at[t][1] - x, self.at[t][2] - y), t) for t in around if self.points[t] >= 2)
        return min((f for f in found if f[0] < self.reach), default=None)


def match_tracks(detonations: DataFrame, tracks: DataFrame) -> DataFrame:
    """(util_id, track_id, n_points): each detonation takes the nearest track that is left, in event order.

    detonations: recording_id, kind, util_id, tick, x, y. tracks: recording_id, kind, track_id, tick, x, y, one row for
    each sample; of several samples at a tick the last by place counts last. A track fits if the detonation falls between
    its first tick and TRACK_MAX_TICKS after its last, it has two points or more up to it and its last point up to it lies
    under TRACK_MAX_DISTANCE away; n_points are those up to the detonation. Taking turns is a matter of order, so samples and
    detonations go through Python as one stream, by recording, kind and tick as Spark has sorted them; a recording and kind
    at a time is held, and swept with its live tracks in a grid.
    """

    def sweep(steps: list[tuple]) -> Iterator[tuple]:
        """steps: (tick, whether a detonation, id, x, y) of one recording and kind, in order."""
        last = {track: tick for tick, event, track, _, _ in steps if not event}
        if not last or not any(step[1] for step in steps):
            return
        live, used, j = LiveTracks(P.TRACK_MAX_DISTANCE), set(), 0
        ends = sorted((tick + P.TRACK_MAX_TICKS, track) for track, tick in last.items())
        for tick, event, name, x, y in steps:
            if not event:
                if name not in used:
                    live.move(name, x, y)
                continue
            while j < len(ends) and ends[j][0] < tick:
                live.drop(ends[j][1])
                j += 1
            best = live.nearest(x, y)
            if best:
                live.drop(best[1])
                used.add(best[1])
                yield name, best[1], live.points[best[1]]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda c: c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist()
        rows = chain.from_iterable(zip(*map(plain, batch.columns), strict=True) for batch in batches)
        found = (match for _, own in groupby(rows, itemgetter(0, 1)) for match in sweep([row[2:] for row in own]))
        while some := list(islice(found, MATCHES_AT_ONCE)):
            util, track, points = zip(*some, strict=True)
            yield pa.record_batch([pa.array(util, pa.int64()), pa.array(track, pa.int64()), pa.array(points, pa.int32())], ["util_id", "track_id", "n_points"])

    step = lambda rows, event, name: rows.select("recording_id", "kind", "tick", F.lit(event).alias("event"), F.col(name).alias("id"), "x", "y")
    steps = step(tracks, False, "track_id").unionAll(step(detonations, True, "util_id"))
    return steps.repartition("recording_id", "kind").sortWithinPartitions(*steps.columns).mapInArrow(solve, "util_id long, track_id long, n_points int")
