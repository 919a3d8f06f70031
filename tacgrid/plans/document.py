"""Documents for a page: a round's playback, a search's statistics and moments. All are bounded, so they may come to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacgrid import params as P
from tacgrid.operators import playback, stats
from tacgrid.operators.filters import filter_snapshots
from tacgrid.operators.moments import ranked
from tacgrid.plans.search import LISTS, Library, Request, hydrate, population, scored
from tacgrid.sources.scratch import shared_folder


def score_keys(ct: Column, t: Column, ct_label: Column, t_label: Column) -> tuple[Column, Column]:
    """Keys by which wins are counted: struct(kind, name).

    The recorded name, unless it is blank or generic; else the core's label. If only one side has a name, the other is
    that side's opponent, and so is followed over half-time.
    """
    plain = lambda own, label: F.when((F.coalesce(own, F.lit("")) != "") & ~F.lower(own).isin(*P.GENERIC_NAMES), own).otherwise(label)
    a, b = plain(ct, ct_label), plain(t, t_label)
    key = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    side = lambda own, other: F.when(own.isNotNull(), key("team", own)).when(other.isNotNull(), key("opponent", other))
    return side(a, b), side(b, a)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def round_document(round_id: int, rounds: DataFrame, snapshots: DataFrame, kills: DataFrame, pieces: DataFrame, shots: DataFrame, roster: DataFrame, context: Callable[[DataFrame], DataFrame] | None = None, weapons: DataFrame | None = None) -> dict:
    """Header, frames, kills (sides repaired), utility, shots and names of one round. KeyError if there is none.

    rounds: round_id, recording_id, ...; snapshots: round_id, tick, sec, planted, players, bomb_x, bomb_y; kills: round_id,
    kill_id, tick, attacker ..., as eliminations; pieces: utility events; shots: round_id, shots; roster: recording_id,
    slot, name. context: from the round's row to more of the header, such as names and score. weapons: weapon_id, name, by which
    the numbers of players' weapons become names, null for those that aren't there.
    """
    own = lambda df: df.where(F.col("round_id") == round_id)
    found = own(rounds)
    header = found.limit(1).collect()
    if not header:
        raise KeyError(round_id)
    names = {r["slot"]: r["name"] for r in roster.where(F.col("recording_id") == header[0]["recording_id"]).collect()}
    guns = {r["weapon_id"]: r["name"] for r in weapons.collect()} if weapons is not None else {}
    tenth = lambda c: F.bround(c, 1)
    frames = _rows(own(snapshots).orderBy("tick").select(F.col("sec").alias("t"), "planted", "players", tenth("bomb_x").alias("bomb_x"), tenth("bomb_y").alias("bomb_y")))
    for f in frames:
        for p in f["players"] or ():
            p["name"] = names.get(p["slot"], "?")
            p.update({c: guns.get(p[c]) for c in ("primary", "secondary") if weapons is not None and c in p})
    seen = own(snapshots).select("round_id", F.explode("players").alias("p")).join(roster.where(F.col("recording_id") == header[0]["recording_id"]).select("slot", "name"), F.col("p.slot") == F.col("slot")).select("round_id", F.col("name").alias("player"), F.col("p.side").alias("side"))
    repaired = playback.repair_sides(own(kills), seen)
    more = _rows(context(found)) if context else []
    return {
        "round": {**header[0].asDict(recursive=True), **(more[0] if more else {})},
        "tick_hz": 1,
        "frames": frames,
        "kills": _rows(repaired.orderBy("tick", "kill_id")),
        "utility": _rows(own(pieces).orderBy("t_start", "util_id")),
        "shots": [[r["seconds"], r["slot"]] for r in playback.decode_shots(own(shots)).orderBy("seconds", "slot").collect()],
        "slots": names,
        "clock": P.ROUND_CLOCK_S,
    }


def stats_document(states: DataFrame, rounds: DataFrame, kills: DataFrame) -> dict:
    """Counts of the rounds that states match; all but rounds and winrate are of the exact ones.

    states: round_id, state_id, sec, planted, in_match, in_exact, in_baseline, where a state may come more than once;
    rounds and kills as in stats. The document has a fixed size, whatever the library's.
    """
    exact = states.where("in_exact")
    reps = stats.representatives(exact).persist()  # looked at once for each of the blocks below
    try:
        own = rounds.join(reps.select("round_id"), "round_id", "left_semi")
        count = stats.round_counts(states, rounds).first()
        bins = {r["bin"]: r["n"] for r in stats.timing(exact).collect()}
        kill = stats.next_kills(reps.select("round_id", "sec"), kills).first()
        sides: dict[str, dict] = {"economy": {"ct": {}, "t": {}}, "win_reasons": {"ct": {}, "t": {}}}
        for r in stats.economy(own).collect():
            sides["economy"][r["side"].lower()][r["buy"]] = r["n"]
        for r in stats.win_reasons(own).collect():
            sides["win_reasons"][r["side"].lower()][r["reason"]] = r["n"]
        named = stats.top_teams(own).orderBy("side", "place").collect()
    finally:
        reps.unpersist()
    kinds = ("exact", "close", "baseline")
    return {
        "rounds": {**{k: count[f"{k}_rounds"] for k in kinds}, "recordings": count["n_recordings"]},
        "winrate": {k: {"ct": count[f"{k}_ct"], "t": count[f"{k}_t"]} for k in kinds},
        "timing": {"bin_s": P.HISTOGRAM_BIN_S, "clock_s": P.ROUND_CLOCK_S, "pre": [bins[i] for i in range(P.HISTOGRAM_BINS)], "post_plant": bins[-1]},
        **sides,
        "teams": {side.lower(): [{"name": r["team"], "rounds": r["n"]} for r in named if r["side"] == side] for side in ("CT", "T")},
        "next_kill": {"ct": kill["ct"], "t": kill["t"], "none": kill["none"], "median_s": kill["seconds"]},
    }


def search_document(lib: Library, request: Request, rounds: DataFrame, kills: DataFrame, labels: DataFrame | None = None) -> dict:
    """Ranked moments with their players, the markers' nodes and the statistics of everything that was recalled.

    moments: request.limit at most, in rank order. The baseline of the statistics is what the filters alone let through;
    without markers all that they let through is exact. Recall runs once: what it finds is written and read by all blocks.
    labels: node, zone of the map; the markers' nodes are then labelled, `node N` where there is none.
    """
    spatial, spark = bool(request.markers), lib.index.sparkSession
    masked = filter_snapshots(lib.index, request.filters)
    plain = ("round_id", "state_id", "sec", "planted")
    flagged = lambda df, match, exact: df.select(*plain, F.lit(match).alias("in_match"), exact.alias("in_exact"), F.lit(True).alias("in_baseline"))
    states, recalled = flagged(masked, not spatial, F.lit(not spatial)), None
    if spatial:
        found, geo = population(lib, request)
        own = [*plain, "cost", "node_cost", *(c for k, c in LISTS.items() if any(m.kind == k for m in request.markers))]
        found.select(*own).write.parquet(path := shared_folder(spark, "recalled"))
        recalled = (spark.read.parquet(path), geo)
        states = states.union(flagged(recalled[0], True, F.col("node_cost") <= P.EXACT))
    best = ranked(scored(lib, request, recalled), request.limit)
    rows = best.collect()
    full = {r["state_id"]: r for r in _rows(hydrate(spark.createDataFrame(rows, best.schema), lib))}
    kinds = ("CT", "T", *LISTS)
    nodes = [m.node for m in request.markers]
    zones = {r["node"]: r["zone"] for r in labels.where(F.col("node").isin(*nodes)).collect()} if labels is not None and nodes else {}
    label = lambda n: {"node": n} if labels is None else {"node": n, "label": zones.get(n, f"node {n}")}
    return {
        "spatial": spatial,
        "moments": [full[r["state_id"]] for r in rows],
        "resolved": {k.lower(): [label(m.node) for m in request.markers if m.kind == k] for k in kinds},
        "n_scanned": lib.index.count(),
        "stats": stats_document(states, rounds, kills),
    }
