"""Rounds while they are played: one row a second with the bomb's last known place, over a stream that may be late and unordered.

State by round: its freeze and end, once they are told, samples that the watermark hasn't passed, and the last place. A
timer at each second that has samples decides them in order when the watermark is past them; a sample is forgotten then,
and a round when its end is decided. What comes out equals carry_forward(resample(...)) of the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tacgrid import params as P

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "round_id long, tick long, is_buy boolean, bomb_x double, bomb_y double"


def milliseconds(tick: int) -> int:
    return tick * 1000 // P.TICKRATE


class Seconds(StatefulProcessor):
    """Decides the samples of a round in order of tick."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bounds = handle.getValueState("bounds", "freeze long, end_tick long, origin long")
        self.place = handle.getValueState("place", "x double, y double")
        self.waiting = handle.getMapState("waiting", "tick long", "x double, y double")

    def _bounds(self) -> list:
        return list(self.bounds.get()) if self.bounds.exists() else [None, None, None]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        freeze, end, origin = self._bounds()
        timers = set()
        for frame in rows:
            for r in frame.itertuples():
                tick = int(r.tick)
                origin = int(r.ts.value // 1_000_000) - milliseconds(tick) if origin is None else origin
                if r.kind == "freeze":
                    freeze = tick
                elif r.kind == "end":
                    end = tick
                else:
                    self.waiting.updateValue((tick,), (None if pd.isna(r.x) else float(r.x), None if pd.isna(r.y) else float(r.y)))
                # The next tick has to be past too: it may be the round's end, which makes this one the buy tick.
                timers.add(-(-(origin + milliseconds(tick + 1) + 1) // 1000) * 1000)
        self.bounds.update((freeze, end, origin))
        for t in timers:
            self.handle.registerTimer(t)
        yield pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        freeze, end, origin = self._bounds()
        past = expiredTimerInfo.getExpiryTimeInMs()
        rows = []
        decided = sorted(int(t[0]) for t in self.waiting.keys() if origin + milliseconds(int(t[0]) + 1) < past)
        x, y = self.place.get() if self.place.exists() else (None, None)
        for tick in decided:
            own_x, own_y = self.waiting.getValue((tick,))
            self.waiting.removeKey((tick,))
            if freeze is None or tick < freeze or (end is not None and tick >= end):
                continue
            buy = freeze + P.BUY_EVAL_SECONDS * P.TICKRATE
            buy = buy if end is None else min(buy, end - 1)
            if tick == buy or (tick - freeze) % P.TICKRATE == 0:
                x, y = x if own_x is None else own_x, y if own_y is None else own_y
                rows.append((int(key[0]), tick, tick == buy, x, y))
        if x is not None or y is not None:
            self.place.update((x, y))
        if end is not None and origin + milliseconds(end + 1) < past:
            self.bounds.clear()
            self.place.clear()
            self.waiting.clear()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def live_seconds(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """A stream of events (round_id, kind, tick, x, y, ts) -> OUT, appended when the watermark has passed a sample.

    kind: freeze or end (of the round, at its tick), or sample, with the place of the bomb's carrier or nulls; ts: the time of
    the tick, TICKRATE to a second. Rows later than `late` are dropped, as a watermark does. A sample before its round's
    freeze, and one after its end, gives no row; of several samples at a tick the last that came counts. A round without a
    freeze gives none. Needs the state store that keeps maps and timers; the setting is made here.
    """
    events.sparkSession.conf.set(STORE, ROCKS)
    own = events.select("round_id", "kind", F.col("tick").cast("long").alias("tick"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "ts").withWatermark("ts", late)
    return own.groupBy("round_id").transformWithStateInPandas(Seconds(), OUT, "append", "eventTime", eventTimeColumnName="")
