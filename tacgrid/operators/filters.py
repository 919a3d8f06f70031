"""Predicates of a search over snapshots joined with their rounds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacgrid import params as P
from tacgrid.functions.scalar import clock_left


@dataclass(frozen=True)
class Filters:
    """All given filters hold together. None or an empty list: not given."""

    bomb_sites: tuple[str, ...] | None = None
    bomb_planted: bool | None = None
    bomb_site: str | None = None
    ct_buy: tuple[str, ...] = ()
    t_buy: tuple[str, ...] = ()
    alive_ct: tuple[int, ...] | None = None
    alive_t: tuple[int, ...] | None = None
    time_range: tuple[int, ...] | None = None
    time_left: tuple[int, ...] | None = None
    smoke_active: bool | None = None
    molly_active: bool | None = None
    team: str | None = None
    team_side: str = "any"


def _sites(sites: tuple[str, ...]) -> Column | None:
    known = {s for s in sites if s in ("A", "B", "none")}
    if len(known) in (0, 3):
        return None
    parts = []
    if {"A", "B"} <= known:
        parts.append(F.col("planted"))
    else:
        parts += [F.col("planted") & (F.col("site") == s) for s in ("A", "B") if s in known]
    if "none" in known:
        parts.append(~F.col("planted"))
    return reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), parts)


def predicate(f: Filters) -> Column:
    """Columns used: planted, site, ct_buy, t_buy, alive_ct, alive_t, sec, n_smoke, n_molly, ct_team, t_team."""
    found: list[Column] = []
    if f.bomb_sites is not None:
        sites = _sites(f.bomb_sites)
        if sites is not None:
            found.append(sites)
    else:
        if f.bomb_planted is not None:
            found.append(F.col("planted") == f.bomb_planted)
        if f.bomb_site is not None:
            found.append(F.col("site") == f.bomb_site)
    for name, wanted in (("ct_buy", f.ct_buy), ("t_buy", f.t_buy)):
        if wanted:
            found.append(F.col(name).isin(*[b for b in wanted if b in P.BUYS]) if set(wanted) & set(P.BUYS) else F.lit(False))
    for name, span in (("alive_ct", f.alive_ct), ("alive_t", f.alive_t), ("sec", f.time_range)):
        if span is not None and len(span) == 2:
            found.append(F.col(name).between(*span))
    if f.time_left is not None and len(f.time_left) == 2:
        found.append(F.col("planted") | clock_left(F.col("sec")).between(min(f.time_left), max(f.time_left)))
    for name, want in (("n_smoke", f.smoke_active), ("n_molly", f.molly_active)):
        if want is not None:
            found.append((F.col(name) > 0) == want)
    if f.team is not None:
        ct, t = F.col("ct_team").eqNullSafe(f.team), F.col("t_team").eqNullSafe(f.team)
        found.append({"ct": ct, "t": t}.get(f.team_side, ct | t))
    return reduce(lambda a, b: a & b, found, F.lit(True))


def playable(samples: DataFrame) -> DataFrame:
    """Samples (team_num, ...) of the two playing sides: no spectators, no null sides."""
    return samples.where(F.col("team_num").isin(P.T_SIDE, P.CT_SIDE))


def searchable(recordings: DataFrame, legacy: bool = True) -> DataFrame:
    """Recordings (map_name, ...) of the maps in play, and of the older ones that can still be searched."""
    return recordings.where(F.col("map_name").isin(*P.ACTIVE_MAPS, *(P.LEGACY_MAPS if legacy else ())))


def decoded(recordings: DataFrame) -> DataFrame:
    """Recordings (status, ...) that were read without an error."""
    return recordings.where("status = 'ok'")


def filter_snapshots(index: DataFrame, f: Filters) -> DataFrame:
    return index.where(predicate(f))
