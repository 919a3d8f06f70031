"""Operators of the scenario engine on small vectors, and queries against their SQL."""

import datetime
import math
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tacgrid import params as P
from tacgrid.functions import scalar as S
from tacgrid.operators import filters, moments, navmesh, playback, recall, rerank, roster, rounds, stats, teams, utility
from tacgrid.plans import document
from tacgrid.plans import search as Q
from tacgrid.sources import store


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_scalars(spark):
    lit = F.lit
    assert list(one(spark, *(S.buy_class(lit(v)) for v in (0, 5000, 5001, 16250, 16251)))) == ["eco", "eco", "semi", "semi", "full"]
    assert list(one(spark, *(S.round_buy(lit(p), lit(b)) for p, b in ((True, "eco"), (False, "eco"), (False, "odd"))))) == ["pistol", "eco", "full"]
    assert list(one(spark, *(S.side_of(lit(v)) for v in ("3", "2", "x", "1")))) == ["CT", "T", None, None]
    assert list(one(spark, *(S.site_of(lit(v)) for v in ("BombsiteA", "BombsiteB", "Bombsite", "Mid", "bombsiteA")))) == ["A", "B", "B", None, None]
    assert list(one(spark, *(S.reason_of(lit(v)) for v in ("t_killed", "other")))) == ["t_killed", None]
    assert list(one(spark, *(S.round_second(lit(v)) for v in (32, 96, -70)), S.round_second(lit(-70), False))) == [0, 2, 0, -1]
    assert list(one(spark, *(S.quantise16(lit(v)) for v in (2.5, 3.5, 1e9, -1e9)))) == [2, 4, 32767, -32768]
    assert list(one(spark, *(S.quantise8(lit(v)) for v in (3.9, -2.0, 300.0)))) == [3, 0, 255]
    assert list(one(spark, *(S.quantise_yaw(lit(v)) for v in (0.0, -90.0, 360.0)))) == [0, 191, 0]
    assert list(one(spark, *(S.clock(lit(v)) for v in (-3, 65, 600)))) == ["0:00", "1:05", "10:00"]
    assert one(spark, S.clock_left(lit(120)))[0] == 0
    assert list(one(spark, *S.token(F.array(lit(9), lit(None), lit(3), lit(7), lit(1), lit(2), lit(0)), 5))) == [0, 1, 2, 3, 7]
    assert one(spark, S.thin_path(F.array(*map(lit, range(10)))))[0] == [0, 4, 8, 9]
    assert list(one(spark, *S.first_teams(F.array(lit(" b"), lit(""), lit("a"), lit("b"), lit("c"))))) == ["a", "b"]
    assert list(one(spark, *S.teams_from_file(lit("big-team-VS-other-m2-map.dem")), *S.teams_from_file(lit("x.dem")))) == ["big team", "other", None, None]
    assert list(one(spark, *S.part_of_file(lit("Match-One-P12.DEM")), *S.part_of_file(lit("Match.dem")))) == ["match-one", 12, None, None]
    assert list(one(spark, S.tidy_name(lit("  a \t b ")), S.tidy_name(lit(" ")), S.tidy_name(lit("x" * 61)))) == ["a b", None, None]
    assert list(one(spark, *(S.valid_player(lit(v)) for v in ("7" * 17, "0" * 17, "7" * 16)))) == [True, False, False]
    assert list(one(spark, S.percent(lit(1), lit(4)), S.percent(lit(1), lit(0)))) == [25.0, 0.0]
    assert one(spark, S.lerp_yaw(lit(350.0), lit(10.0), lit(0.5)))[0] == pytest.approx(0.0)
    assert list(one(spark, *S.side_names(lit("a"), lit("a"), lit("b"), lit(None), lit(None)), *S.side_names(lit("x"), lit("a"), lit("b"), lit("core"), lit(None)))) == ["a", "b", "core", None]
    px = S.world_to_pixel(lit(120.0), lit(-40.0), -2000.0, 1500.0, 4.5)
    assert list(one(spark, *S.pixel_to_world(*px, -2000.0, 1500.0, 4.5))) == pytest.approx([120.0, -40.0])
    square = F.array(*(F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))))
    assert list(one(spark, *(S.inside_polygon(lit(x), lit(y), square) for x, y in ((2.0, 2.0), (5.0, 2.0), (-1.0, 2.0))))) == [True, False, False]


def test_inventory(spark):
    items = lambda *names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    r = one(spark, S.inventory(items("Zeus x27", "AK-47", "AWP", "Glock-18", "Flashbang", "Flashbang", "Flashbang", "Flashbang", "Molotov")), S.inventory(items("Zeus x27", "Knife")), S.inventory(items()), S.has_bomb(items("C4 Explosive")))
    assert (r[0]["primary"], r[0]["secondary"], r[0]["flashes"], r[0]["molly"], r[0]["smoke"]) == ("awp", "glock", 3, True, False)
    assert (r[1]["primary"], r[1]["secondary"]) == (None, "taser") and r[2]["secondary"] is None and r[3]


INDEX = "state_id long, planted boolean, site string, ct_buy string, t_buy string, alive_ct int, alive_t int, sec int, n_smoke int, n_molly int, ct_team string, t_team string"


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (dict(), [1, 2, 3, 4]),
        (dict(bomb_sites=("A",)), [2]),
        (dict(bomb_sites=("A", "B")), [2, 3]),
        (dict(bomb_sites=("none",)), [1, 4]),
        (dict(bomb_sites=("B", "none")), [1, 4]),
        (dict(bomb_sites=("A", "B", "none")), [1, 2, 3, 4]),
        (dict(bomb_sites=("?",)), [1, 2, 3, 4]),
        (dict(bomb_sites=()), [1, 2, 3, 4]),
        (dict(bomb_planted=True), [2, 3]),
        (dict(bomb_site="A"), [1, 2]),
        (dict(bomb_sites=("none",), bomb_planted=True), [1, 4]),
        (dict(ct_buy=("eco", "nonsense")), [1]),
        (dict(ct_buy=("nonsense",)), []),
        (dict(alive_ct=(3, 5)), [1, 2]),
        (dict(alive_ct=(5, 3)), []),
        (dict(alive_ct=(3,)), [1, 2, 3, 4]),
        (dict(time_range=(10, 20)), [2]),
        (dict(time_left=(110, 100)), [1, 2, 3]),
        (dict(smoke_active=True), [1]),
        (dict(smoke_active=False, molly_active=True), [2]),
        (dict(team="x"), [1, 2]),
        (dict(team="x", team_side="ct"), [1]),
        (dict(team="X"), []),
    ],
)
def test_filters(spark, f, want):
    rows = [
        (1, False, "A", "eco", "full", 5, 5, 5, 1, 1, "x", "y"),
        (2, True, "A", "semi", "full", 3, 4, 20, 0, 2, "y", "x"),
        (3, True, None, "full", "eco", 2, 1, 60, 0, 0, None, "y"),
        (4, False, None, "pistol", "pistol", 0, 0, 90, 0, 0, None, None),
    ]
    got = filters.filter_snapshots(spark.createDataFrame(rows, INDEX), filters.Filters(**f))
    assert sorted(r["state_id"] for r in got.collect()) == want


GEO = recall.Geodesics({0: [0.0, 100.0, 1000.0], 1: [100.0, 0.0, 100.0], 2: [1000.0, 100.0, 0.0]}, 1000.0)


def test_chamfer(spark):
    df = spark.createDataFrame([(1, 0, 2), (2, None, None), (3, 1, None)], "state_id long, a int, b int")
    marks = [recall.Marker("CT", 0, 0.0, 0.0), recall.Marker("CT", 2, 0.0, 0.0)]
    got = df.select("state_id", recall.chamfer(GEO, marks, [F.col("a"), F.col("b")]).alias("c"))
    assert {r[0]: r[1] for r in got.collect()} == {1: 0.0, 2: 1000.0, 3: 100.0}
    both = recall.recall_cost(GEO, [marks[0], recall.Marker("T", 1, 0.0, 0.0)], {"CT": [F.col("a")], "T": [F.col("b")]})
    assert {r[0]: r[1] for r in df.select("state_id", both.alias("c")).collect()} == {1: 50.0, 2: 1000.0, 3: 550.0}
    assert df.select(recall.recall_cost(GEO, [], {}).alias("c")).first()[0] == 0.0


def plain_assignment(players, markers):
    k, m = len(markers), min(5, len(players))
    if not m:
        return GEO.pad
    cost = lambda p, q: max(GEO.rows[q.node][p[0]], math.hypot(p[1] - q.x, p[2] - q.y))
    best = min(sum(cost(players[j], markers[i]) for i, j in enumerate(own)) for own in permutations(range(m), min(k, m)))
    return (best + GEO.pad * max(0, k - m)) / k


@pytest.mark.parametrize("k", [1, 2, 3])
def test_assignment_as_brute_force(spark, k):
    marks = [recall.Marker("CT", n, 10.0 * n, 5.0) for n in (2, 0, 1)][:k]
    people = {s: [((s * 7 + j * 5) % 3, 40.0 * ((s + j) % 4), 30.0 * (j % 3)) for j in range(s % 6)] for s in range(1, 13)}
    df = spark.createDataFrame(list(people.items()), "state_id long, p array<struct<node:int,x:double,y:double>>")
    found = {r[0]: r[1] for r in df.select("state_id", rerank.assignment_cost(F.col("p"), marks, GEO)).collect()}
    assert found == {s: pytest.approx(plain_assignment(own, marks)) for s, own in people.items()}
    strict = {r[0]: r[1] for r in df.select("state_id", rerank.assignment_cost(F.col("p"), marks, GEO, strict_optimal=True)).collect()}
    assert strict == {s: pytest.approx(min(plain_assignment(own, list(x)) for x in permutations(marks))) for s, own in people.items()}


def test_utility_radius(spark):
    one_of = lambda x: [(0, x, 0.0)]
    df = spark.createDataFrame([(1, one_of(249.9)), (2, one_of(250.0)), (3, one_of(250.1)), (4, []), (5, None)], "state_id long, u array<struct<node:int,x:double,y:double>>")
    c = rerank.utility_cost([recall.Marker("smoke", 0, 0.0, 0.0)], GEO, F.col("u"))
    assert {r[0]: r[1] for r in df.select("state_id", c).collect()} == {1: 249.9, 2: 250.0, 3: None, 4: None, 5: None}


def test_moments_and_ranking(spark):
    rows = [(1, 1, 11, 5.0, 5.0), (1, 2, 12, 3.0, 0.0), (1, 4, 13, 3.0, 4.0), (1, 7, 14, 1.0, 1.0), (2, 8, 21, 3.0, 3.0), (2, 9, 22, 3.0, 2.0)]
    runs = moments.moments(spark.createDataFrame(rows, "round_id long, sec int, state_id long, score double, cost double"))
    got = [(r["round_id"], r["t_start"], r["t_end"], r["score"], r["state_id"], r["exact"]) for r in moments.ranked(runs).collect()]
    assert got == [(1, 1, 4, 3.0, 12, True), (1, 7, 7, 1.0, 14, False), (2, 8, 9, 3.0, 21, False)]
    assert moments.ranked(runs, 1).count() == 1
    with pytest.raises(ValueError):
        moments.ranked(runs, 0)


def test_active_utility_bounds_and_cap(spark):
    snaps = spark.createDataFrame([(s, 1, s) for s in range(1, 8)] + [(99, 2, 3)], "state_id long, round_id long, sec int")
    pieces = [(k, 1, "smoke", 3, 5) for k in range(12)] + [(50, 1, "molly", 4, None)]
    got = utility.active(snaps, spark.createDataFrame(pieces, "util_id long, round_id long, kind string, t_start int, t_end int")).collect()
    assert {s: sum(r["state_id"] == s and r["kind"] == "smoke" for r in got) for s in range(1, 8)} == {1: 0, 2: 0, 3: 10, 4: 10, 5: 10, 6: 0, 7: 0}
    assert [r["state_id"] for r in got if r["kind"] == "molly"] == [4] and max(r["util_id"] for r in got if r["kind"] == "smoke") == 9


def test_rounds_from_events(spark):
    freezes = [(1, 100, True), (1, 200, None), (1, 900, False), (1, 950, False), (1, 5000, False), (2, 10, False)]
    ends = [(1, 1000, "CT", "t_killed"), (1, 2000, "T", "x"), (1, 5639, "CT", None), (1, 6300, "CT", None), (2, 650, "T", None), (2, 9999, None, None)]
    got = rounds.build_rounds(spark.createDataFrame(freezes, "recording_id long, tick long, warmup boolean"), spark.createDataFrame(ends, "recording_id long, tick long, winner string, reason string"))
    rows = sorted((r["recording_id"], r["round_no"], r["freeze"], r["end_tick"], r["is_pistol"]) for r in got.collect())
    assert rows == [(2, 1, 10, 650, True)]


def test_rounds_skip_winnerless_ends_and_what_lies_before_a_start(spark):
    freezes = [(1, 100, None), (2, 100, None), (2, 3000, None), (2, 9000, None), (3, 50, None)]
    ends = [(1, 500, None, None), (1, 2000, "CT", None), (2, 2000, "T", None), (2, 4500, "T", None), (2, 9900, "CT", None), (3, 1000, "T", "a"), (3, 1000, "CT", "b"), (3, 1000, "CT", "b")]
    starts = spark.createDataFrame([(2, 3000), (2, 2500), (9, 1)], "recording_id long, tick long")
    got = rounds.build_rounds(spark.createDataFrame(freezes, "recording_id long, tick long, warmup boolean"), spark.createDataFrame(ends, "recording_id long, tick long, winner string, reason string"), starts)
    rows = sorted((r["recording_id"], r["round_no"], r["freeze"], r["end_tick"], r["winner"]) for r in got.collect())
    assert rows == [(1, 1, 100, 2000, "CT"), (2, 1, 3000, 4500, "T"), (2, 2, 9000, 9900, "CT"), (3, 1, 50, 1000, "CT")]


def test_equal_events_stay_as_many(spark):
    r = spark.createDataFrame([(1, 1, 100, 200), (1, 2, 200, 300)], "recording_id long, round_id long, freeze long, end_tick long")
    e = spark.createDataFrame([(1, 150), (1, 150), (1, 200), (1, 200)], "recording_id long, tick long")
    assert sorted(x["round_id"] for x in rounds.attach_round(e, r, ["recording_id"]).collect()) == [1, 1, 2, 2]


def test_attach_round_edges(spark):
    r = spark.createDataFrame([(1, 1, 100, 200), (1, 2, 200, 300)], "recording_id long, round_id long, freeze long, end_tick long")
    e = spark.createDataFrame([(1, t) for t in (99, 100, 200, 300, 301)], "recording_id long, tick long")
    own = {x["tick"]: x["round_id"] for x in rounds.attach_round(e, r, ["recording_id"]).collect()}
    assert own == {100: 1, 200: 2, 300: 2}
    assert {x["tick"] for x in rounds.attach_round(e, r, ["recording_id"], inclusive=False).collect()} == {100, 200}


def test_carry_forward(spark):
    rows = [(1, 1, None, None), (1, 2, 5.0, 6.0), (1, 3, None, None), (1, 4, 9.0, 9.0), (1, 5, None, None), (2, 1, None, None)]
    s = spark.createDataFrame(rows, "round_id long, tick long, carrier_x double, carrier_y double")
    plants = spark.createDataFrame([(1, 4, 1.0, 2.0), (2, 1, None, None)], "round_id long, plant_tick long, plant_x double, plant_y double")
    got = {(r["round_id"], r["tick"]): (r["bomb_x"], r["bomb_y"]) for r in rounds.carry_forward(s, plants).collect()}
    assert got == {(1, 1): (None, None), (1, 2): (5.0, 6.0), (1, 3): (5.0, 6.0), (1, 4): (1.0, 2.0), (1, 5): (1.0, 2.0), (2, 1): (None, None)}


def test_shots(spark):
    fire = [(1, 110, "p", "weapon_ak47"), (1, 105, "q", "awp"), (1, 120, "p", "weapon_knife_t"), (1, 130, "p", "weapon_hegrenade"), (1, 140, "z", "ak47"), (1, 90, "p", "ak47"), (1, 150, "p", None)]
    got = rounds.shots(
        spark.createDataFrame(fire, "recording_id long, tick long, player string, weapon string"),
        spark.createDataFrame([(1, 7, 100, 200)], "recording_id long, round_id long, freeze long, end_tick long"),
        spark.createDataFrame([(1, "p", 3), (1, "q", 4)], "recording_id long, player string, slot int"),
    )
    assert [tuple(x) for x in got.first()["shots"]] == [(5, 4), (10, 3), (50, 3)]
    assert [(r["seconds"], r["slot"]) for r in playback.decode_shots(got).collect()] == [(0.08, 4), (0.16, 3), (0.78, 3)]


def test_roster(spark):
    rows = [(1, f"p{k:02}", True) for k in range(11)] + [(1, "p00", True), (1, "coach", False), (1, "coach", None), (1, "p10", False)]
    got = roster.select_roster(spark.createDataFrame(rows, "recording_id long, player string, alive boolean"))
    assert [(r["player"], r["slot"]) for r in got.orderBy("slot").collect()] == [(f"p{k:02}", k) for k in (*range(9),)] + [("p10", 9)]


def test_sides_and_zones(spark):
    rows = [(1, "a", "CT"), (1, "a", "T"), (1, "b", "CT"), (1, "b", "CT"), (1, "b", "T"), (1, "c", None)]
    s = spark.createDataFrame(rows, "round_id long, player string, side string")
    assert {r["player"]: r["side"] for r in roster.player_sides(s).collect()} == {"a": "T", "b": "CT"}
    assert {r["player"]: r["side"] for r in roster.membership(s).collect()} == {"b": "CT"}
    kills = spark.createDataFrame([(1, "b", None, "a", None), (1, "b", "T", "z", None)], "round_id long, attacker string, attacker_side string, victim string, victim_side string")
    assert sorted((r["attacker_side"], r["victim_side"]) for r in playback.repair_sides(kills, s).collect() if r["victim_side"]) == [("CT", "T")]


def test_next_kill(spark):
    anchors = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "round_id long, sec int")
    kills = [(1, 1, 320, 5, "CT"), (2, 1, 400, 6, None), (3, 1, 500, 8, "T"), (4, 2, 700, 11, "CT"), (5, 3, 700, 13, "T")]
    got = stats.next_kills(anchors, spark.createDataFrame(kills, "kill_id long, round_id long, tick long, round_sec int, victim_side string")).first()
    assert tuple(got) == (2, 1, 1, 6)
    even = stats.next_kills(anchors.where("round_id < 3"), spark.createDataFrame(kills, "kill_id long, round_id long, tick long, round_sec int, victim_side string")).first()
    assert even["seconds"] == 4


def test_cores(spark):
    people = spark.createDataFrame([(1, p, "CT") for p in (1, 2, 3, 4, 5)] + [(1, p, "T") for p in (6, 7, 8)] + [(2, 1, "CT"), (2, 2, "CT"), (2, 3, "T")], "round_id long, pid long, side string")
    members = spark.createDataFrame([(10, p) for p in (1, 2, 3)] + [(11, p) for p in (3, 4, 5)] + [(12, p) for p in (6, 7, 8)] + [(13, p) for p in (5, 6, 7)], "core_id long, pid long")
    found = teams.core_matches(people, members)
    assert sorted(map(tuple, found.collect())) == [(1, "CT", 10), (1, "CT", 11), (1, "T", 12)]
    assert sorted(map(tuple, teams.unique_matches(found).collect())) == [(1, "T", 12)]
    assert sorted(map(tuple, teams.core_stats(found, members).collect())) == [(10, 0, 1), (11, 0, 1), (12, 1, 0), (13, 0, 0)]


def test_core_checks(spark):
    ids = [str(k) * 17 for k in range(1, 6)]
    known = spark.createDataFrame([(i,) for i in ids], "pid string")
    saved = spark.createDataFrame([(1, "First")], "core_id long, name string")
    check = lambda *a: teams.check_core(*a[:2], known, saved, *a[2:])
    assert check("new", ids[:3]) == [] and check("first", ids[:3], 1) == []
    assert len(check("FIRST ", ids[:3])) == 1 and len(check(" ", ids[:2])) == 2 and len(check("x", [*ids[:2], "9" * 17])) == 1 and len(check("x", [*ids[:2], "12"])) == 2 and check("x", ids[:3], 7)


def test_parts_and_numbers(spark):
    rows = [(100 + k, rec, k, pre, part, 1, day) for rec, pre, part, day in ((1, "m", 2, None), (2, "m", 1, None), (3, "m", 3, "d"), (4, None, None, None)) for k in range(1, 8)]
    df = spark.createDataFrame(rows, "round_id long, recording_id long, round_no int, prefix string, part int, map_id int, day string")
    got = {(r["recording_id"], r["round_no"]): (r["match_round"], r["is_pistol"]) for r in rounds.number_parts(df).collect()}
    assert got[2, 1] == (1, True) and got[1, 1] == (8, False) and got[1, 6] == (13, True) and got[3, 1] == (1, True) and got[4, 2] == (2, False)
    ids = {r["recording_id"]: r["match_id"] for r in playback.siblings(df.select("recording_id", "prefix", "part", "map_id", "day").distinct()).collect()}
    assert ids == {1: 2, 2: 2, 3: 3, 4: 4}


def test_score_follows_teams(spark):
    rows = [(1, 1, 1, "CT", "a", "b"), (1, 2, 2, "T", "a", "b"), (1, 3, 3, None, "a", "b"), (1, 4, 4, "T", "b", "a"), (1, 5, 5, "CT", "b", "a")]
    df = spark.createDataFrame(rows, "match_id long, match_round int, round_id long, winner string, ct_key string, t_key string")
    assert {r["round_id"]: (r["ct_score"], r["t_score"]) for r in playback.running_score(df).collect()} == {1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (1, 1), 5: (1, 2)}


def test_tracks(spark):
    samples = spark.createDataFrame([(1, t) for t in (0, 128, 257, 300, 700)], "entity long, tick long")
    assert sorted((r["tick"], r["session"]) for r in utility.sessions(samples, ["entity"]).collect()) == [(0, 0), (128, 0), (257, 1), (300, 1)]
    det = spark.createDataFrame([(1, "smoke", 1, 100, 0.0, 0.0), (1, "smoke", 2, 110, 0.0, 0.0), (1, "smoke", 3, 120, 5000.0, 0.0), (1, "smoke", 4, 400, 0.0, 300.0)], "recording_id long, kind string, util_id long, tick long, x double, y double")
    tracks = [(1, "smoke", 7, t, 0.0, 10.0) for t in (50, 90, 130)] + [(1, "smoke", 8, t, 0.0, 200.0) for t in (60, 100)] + [(1, "smoke", 9, 300, 0.0, 300.0)] + [(1, "smoke", 10, t, 0.0, 0.0) for t in (380, 390)]
    got = utility.match_tracks(det, spark.createDataFrame(tracks, "recording_id long, kind string, track_id long, tick long, x double, y double"))
    assert sorted(map(tuple, got.collect())) == [(1, 7, 2), (2, 8, 2)]  # 4 lies exactly 300 away from track 10


def test_tween_and_feed(spark):
    frames = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 350.0), (1, 0, 2.0, 8.0, 4.0, 10.0)], "round_id long, player int, sec double, x double, y double, yaw double")
    got = [(r["sec"], r["x"], round(r["yaw"], 3)) for r in playback.tween(frames, 2).orderBy("sec").collect()]
    assert got == [(1.0, 0.0, 350.0), (1.5, 4.0, 0.0), (2.0, 8.0, 10.0)]
    kills = spark.createDataFrame([(k, 1, k) for k in range(1, 13)], "kill_id long, round_id long, round_sec int")
    feed = playback.kill_feed(kills, spark.createDataFrame([(1, 10)], "round_id long, t int"))
    assert sorted(r["kill_id"] for r in feed.collect()) == [5, 6, 7, 8, 9, 10]


def grid(spark, n=4):
    areas = spark.createDataFrame([("m", r * n + c, 2500.0, 50.0 * c, 50.0 * r, 0.0) for r in range(n) for c in range(n)], "map_name string, area_id long, size double, x double, y double, z double")
    edges = [("m", r * n + c, r * n + c + 1) for r in range(n) for c in range(n - 1)] + [("m", r * n + c, r * n + c + n) for r in range(n - 1) for c in range(n)]
    return areas, spark.createDataFrame(edges, "map_name string, a long, b long")


def test_clusters(spark):
    areas, edges = grid(spark)
    nodes = navmesh.cluster_areas(areas, edges, 4)
    first = {r["area_id"]: r["node"] for r in nodes.collect()}
    assert first == {r["area_id"]: r["node"] for r in navmesh.cluster_areas(areas, edges, 4).collect()}
    assert sorted(first) == list(range(16)) and set(first.values()) == set(range(4))
    near = {(a, b) for _, a, b in map(tuple, navmesh.symmetric(edges).collect())}
    for node in range(4):  # each is connected
        own = {a for a, k in first.items() if k == node}
        seen, todo = set(), [min(own)]
        while todo:
            a = todo.pop()
            seen.add(a)
            todo += [b for b in own - seen if (a, b) in near]
        assert seen == own
    centres = navmesh.node_centres(areas, nodes)
    geo = navmesh.geodesics(navmesh.node_edges(edges, nodes, centres)).toPandas().pivot(index="na", columns="nb", values="d").to_numpy()
    assert (geo == geo.T).all() and (geo.diagonal() == 0).all() and (geo < 4000).all()
    with pytest.raises(Exception, match="nodes"):
        navmesh.cluster_areas(areas, edges, 300).count()
    assert (navmesh.default_k(10), navmesh.default_k(2000), navmesh.default_k(9999)) == (60, 100, 180)


def plain_raster(areas, cell=16, layers=3, gap=64.0, margin=2):
    """Cell by cell: (origin, width, height, {(ix, iy): [(node, z)]})."""
    xs, ys = [x for a in areas for x, _ in a[3]], [y for a in areas for _, y in a[3]]
    x0, y0 = min(xs) - margin * cell, min(ys) - margin * cell
    w, h = math.ceil((max(xs) + margin * cell - x0) / cell), math.ceil((max(ys) + margin * cell - y0) / cell)
    cells = {}
    for _, node, z, corners in sorted(areas):
        quad = [corners[round(k * (len(corners) - 1) / 3)] for k in range(4)]
        hit = []
        for ix in range(w):
            for iy in range(h):
                px, py, odd = x0 + (ix + 0.5) * cell, y0 + (iy + 0.5) * cell, False
                for (ax, ay), (bx, by) in zip(quad, quad[-1:] + quad[:-1], strict=True):
                    if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                        odd = not odd
                if odd:
                    hit.append((ix, iy))
        if not hit:
            hit = [(int((sum(x for x, _ in quad) / 4 - x0) / cell), int((sum(y for _, y in quad) / 4 - y0) / cell))]
        for at in hit:
            own = cells.setdefault(at, [])
            if len(own) < layers and all(abs(z - other) >= gap for _, other in own):
                own.append((node, z))
    return (x0, y0), w, h, cells


def plain_dilation(cells, w, h, rounds):
    cells = dict(cells)
    for _ in range(rounds):
        for dx, dy in P.RASTER_SIDES:
            there = dict(cells)
            for x in range(w):
                for y in range(h):
                    if (x, y) not in cells and (x - dx, y - dy) in there:
                        cells[x, y] = there[x - dx, y - dy]
    return cells


AREAS = [  # around the origin; storeys 63, 64 and 200 apart, one above another; five corners; one smaller than a cell
    (1, 0, 0.0, [(-100.0, -60.0), (-36.0, -60.0), (-36.0, 4.0), (-100.0, 4.0)]),
    (2, 1, 200.0, [(-100.0, -60.0), (-68.0, -60.0), (-68.0, -28.0), (-100.0, -28.0)]),
    (3, 2, 63.0, [(-100.0, -60.0), (-68.0, -60.0), (-68.0, -28.0), (-100.0, -28.0)]),
    (4, 3, 64.0, [(-68.0, -60.0), (-36.0, -60.0), (-36.0, -28.0), (-68.0, -28.0)]),
    (5, 4, 10.0, [(40.0, 40.0), (90.0, 30.0), (120.0, 60.0), (100.0, 110.0), (50.0, 100.0)]),
    (6, 5, 0.0, [(60.5, -50.5), (62.5, -50.5), (62.5, -48.5), (60.5, -48.5)]),
]


def test_raster_as_cell_by_cell(spark):
    df = spark.createDataFrame([("m", *a) for a in AREAS], "map_name string, area_id long, node int, z double, corners array<struct<x:double,y:double>>")
    raster = navmesh.rasterise(df).cache()

    def cells_of(frame):
        out = {}
        for r in frame.collect():
            out.setdefault((r["ix"], r["iy"]), {})[r["layer"]] = (r["node"], r["z"])
        return {at: [own[k] for k in sorted(own)] for at, own in out.items()}

    origin, w, h, cells = plain_raster(AREAS)
    first = raster.first()
    assert (first["x0"], first["y0"], first["width"], first["height"]) == (*origin, w, h)
    assert cells_of(raster) == cells
    for rounds_ in (1, 2, 80):
        assert cells_of(navmesh.dilate(raster, rounds_)) == plain_dilation(cells, w, h, min(rounds_, w + h))
    points = [(x + 0.25, y + 0.5, z) for x in range(-140, 160, 9) for y in range(-100, 150, 13) for z in (-5.0, 31.0, 32.5, 150.0)]
    found = navmesh.locate(spark.createDataFrame([("m", *p) for p in points], "map_name string, x double, y double, z double"), raster).collect()

    def plain(x, y, z):
        own = cells.get((int((x - origin[0]) / 16), int((y - origin[1]) / 16)), [])
        return min(((abs(oz - z), k, node) for k, (node, oz) in enumerate(own)), default=(0, 0, None))[2]

    assert len(found) == len(points) and all(r["node"] == plain(r["x"], r["y"], r["z"]) for r in found)


def test_storeys_merge_by_links(spark):
    """Areas one above another are near in the plane, however far apart in height."""
    rows = [("m", 1, 1.0, 0.0, 0.0, 0.0), ("m", 2, 9.0, 0.0, 0.0, 900.0), ("m", 3, 9.0, 300.0, 0.0, 0.0)]
    areas = spark.createDataFrame(rows, "map_name string, area_id long, size double, x double, y double, z double")
    edges = spark.createDataFrame([("m", 1, 2), ("m", 1, 3)], "map_name string, a long, b long")
    own = {r["area_id"]: r["node"] for r in navmesh.cluster_areas(areas, edges, 2).collect()}
    assert own[1] == own[2] != own[3]


def test_a_map_from_areas_to_store(spark, tmp_path):
    areas, edges = grid(spark)
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    made = navmesh.build_map(areas.withColumn("corners", F.array(corner(0, 0), corner(50, 0), corner(50, 50), corner(0, 50))), edges, 4)
    library = store.Library(spark, str(tmp_path))
    library.write_map(made)
    assert library.read("geo").count() == 16 and library.read("areas").count() == 16 and library.read("raster").where("map_name = 'm'").count() > 100
    with pytest.raises(ValueError):
        library.write_map({"other": areas})


def test_small_filters_and_names(spark):
    samples = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 1, "c"), (4, None, "d")], "tick long, team_num int, name string")
    assert [r["tick"] for r in filters.playable(samples).orderBy("tick").collect()] == [1, 2]
    maps = spark.createDataFrame([("de_nuke", "ok"), ("de_overpass", "error"), ("x", "ok")], "map_name string, status string")
    assert filters.searchable(maps).count() == 2 and filters.searchable(maps, legacy=False).count() == 1 and filters.decoded(maps).count() == 2
    aliases = spark.createDataFrame([("NAVI", "Natus"), ("navi", "Natus")], "alias string, canonical string")
    teams_ = spark.createDataFrame([("Navi", 1), ("x", 2), (None, 3)], "team string, n int")
    assert {r["n"]: r["team"] for r in teams.canonical(teams_, aliases).collect()} == {1: "Natus", 2: "x", 3: None}


def test_search_finds_itself(spark):
    """A sketch of a state's own players comes first with score 0, and near the top after small moves."""
    nodes = [(s, k, "CT" if k < 2 else "T", (s * 5 + k * 3) % 3, float((s * 37 + k * 11) % 90), float((s * 53 + k * 29) % 70)) for s in range(1, 40) for k in range(4)]
    players = spark.createDataFrame(nodes, "state_id long, slot int, side string, node int, x double, y double").withColumn("alive", F.lit(True))
    index = players.groupBy("state_id").agg(*(F.max(F.when(F.col("slot") == k, F.col("node"))).alias(f"n{k}") for k in range(4))).select("*", F.col("state_id").alias("round_id"), F.lit(5).alias("sec"))
    geo = spark.createDataFrame([(a, b, GEO.rows[a][b]) for a in range(3) for b in range(3)], "na int, nb int, d double")
    nested = players.groupBy("state_id").agg(F.collect_list(F.struct("slot", "side", "alive", "node", "x", "y")).alias("players"))
    people = lambda ids: nested.join(F.broadcast(ids), "state_id")
    lib = Q.Library(index, people, geo, {"CT": [F.col("n0"), F.col("n1")], "T": [F.col("n2"), F.col("n3")]})
    own = [r for r in nodes if r[0] == 17]
    marks = tuple(recall.Marker(side, node, x, y) for _, _, side, node, x, y in own)
    best = Q.search(lib, Q.Request(marks)).first()
    assert best["state_id"] == 17 and best["score"] == 0 and best["exact"]
    moved = tuple(recall.Marker(m.kind, m.node, m.x + 4, m.y - 4) for m in marks)
    assert 17 in [r["state_id"] for r in Q.search(lib, Q.Request(moved, limit=3)).collect()]
    about = lib.index.select("*", *(F.lit(1).alias(c) for c in ("recording_id", "map_id", "winner", "ct_team", "t_team", "planted")))
    full = Q.hydrate(Q.search(lib, Q.Request(marks)).limit(1), Q.Library(about, people, geo, lib.tokens)).first()
    assert full["state_id"] == 17 and [p["slot"] for p in full["players"]] == [0, 1, 2, 3]
    about_rounds = lib.index.select("round_id", F.lit(1).alias("recording_id"), F.lit("T").alias("winner"), F.lit(None).cast("string").alias("win_reason"), *(F.lit("x").alias(c) for c in ("ct_team", "t_team", "ct_buy", "t_buy")))
    kills = spark.createDataFrame([], "kill_id long, round_id long, tick long, round_sec int, victim_side string")
    whole = Q.Library(about.withColumn("planted", F.lit(False)), people, geo, lib.tokens)
    doc = document.search_document(whole, Q.Request(marks, limit=2), about_rounds, kills)
    assert [m["state_id"] for m in doc["moments"]] == [r["state_id"] for r in Q.search(lib, Q.Request(marks, limit=2)).collect()]
    assert doc["resolved"]["ct"] == [{"node": m.node} for m in marks[:2]] and doc["n_scanned"] == 39 and doc["stats"]["rounds"]["baseline"] == 39
    same = {s for s in range(1, 40) if all({r[3] for r in nodes if r[0] == s and r[2] == k} == {m.node for m in marks if m.kind == k} for k in ("CT", "T"))}
    assert doc["stats"]["rounds"]["exact"] == doc["stats"]["winrate"]["exact"]["t"] == len(same) > 1
    assert document.search_document(whole, Q.Request(limit=1), about_rounds, kills)["stats"]["rounds"] == {"exact": 39, "close": 0, "baseline": 39, "recordings": 1}
    assert Q.search(lib, Q.Request()).count() == 39 or Q.search(lib, Q.Request(limit=100)).count() == 39
    assert Q.search(lib, Q.Request((recall.Marker("CT", 0, 0.0, 0.0),), tolerance=-1.0)).count() == 0


def test_sources(spark, tmp_path):
    from tacgrid.sources import files, navjson, store

    (tmp_path / "a/b").mkdir(parents=True)
    for name, data in (("a/x.dem", b"1" * 10), ("a/b/y.dem", b"1" * 10), ("z.dem", b"2"), ("no.txt", b"")):
        (tmp_path / name).write_bytes(data)
    keys = files.content_keys(spark, str(tmp_path))
    assert keys.count() == files.discover(spark, str(tmp_path)).count() == 3
    fresh = files.new_files(keys.select("path", "content_key"), keys.where("size = 1"))
    assert [r["path"].endswith("a/b/y.dem") for r in fresh.collect()] == [True]
    rows = spark.createDataFrame([(1, "x.dem", 10, "k2"), (2, "gone.dem", 1, "k")], "recording_id long, name string, size long, content_key string")
    there = spark.createDataFrame([("x.dem", 10, "/1", "k1"), ("x.dem", 10, "/2", "k2")], "name string, size long, path string, content_key string")
    assert [tuple(r) for r in files.resolve(rows, there).collect()] == [(1, "/2")]
    nav = tmp_path / "nav.json"
    corner = lambda *p: [dict(zip("xyz", q, strict=True)) for q in p]
    import json

    nav.write_text("\n".join(json.dumps(x) for x in [
        {"map_name": "m", "area_id": 1, "corners": corner((0, 0, 0), (10, 0, 0), (10, 4, 0), (0, 4, 0)), "connections": [2, 3, 9]},
        {"map_name": "m", "area_id": 2, "corners": corner((0, 0, 0), (1, 0, 0), (0, 1, 0)), "connections": []},
        {"map_name": "m", "area_id": 3, "corners": corner((0, 0, 0), (1, 0, 0)), "connections": [1]},
    ]))
    areas = navjson.read_areas(spark, str(nav))
    assert {r["area_id"]: (r["size"], r["x"]) for r in areas.collect()} == {1: (40.0, 5.0), 2: (1.0, pytest.approx(1 / 3))}
    assert sorted((r["a"], r["b"]) for r in navjson.area_edges(areas).collect()) == [(1, 2), (2, 1)]
    assert navjson.calibrations({"m": {"a": 1, "b": 2}}, "not json", '{"m": {"b": 3}, "n": {"c": 4}}') == {"m": {"a": 1, "b": 3}, "n": {"c": 4}}
    lib = store.Library(spark, str(tmp_path / "lib"))
    lib.write("rounds", spark.createDataFrame([(1, 10), (2, 20)], "recording_id long, round_id long"))
    lib.write("rounds", spark.createDataFrame([(2, 21)], "recording_id long, round_id long"))
    assert sorted(r["round_id"] for r in lib.read("rounds").collect()) == [10, 21] and lib.size() > 0
    lib.remove(1)
    assert [r["round_id"] for r in lib.read("rounds").collect()] == [21]
    lib.clear()
    assert not lib.has("rounds")
    bad = spark.createDataFrame([("/p", "k", "x" * 900), ("/q", "known", "y")], "path string, content_key string, message string")
    q = store.quarantine(bad, spark.createDataFrame([("known",)], "content_key string")).first()
    assert (q["path"], len(q["error"])) == ("/p", 500)
    rec = spark.createDataFrame([(1, "f", None, 5), (2, "g", "e", 6)], "recording_id long, file_name string, event string, match_ref long")
    over = spark.createDataFrame([("f", "E", 9), ("g", "E", 9)], "file_name string, event string, match_ref long")
    assert sorted(tuple(r) for r in store.apply_metadata(rec, over).collect()) == [(1, "f", "E", 9), (2, "g", "e", 6)]
    assert files.event_table(spark, str(tmp_path), "missing", "a long").count() == 0


def test_streaming(spark, tmp_path):
    from tacgrid.streaming import ingest

    schema = "round_id long, ts timestamp, state_id long, score double"
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, at(1), 1, 5.0), (1, at(2), 2, 3.0), (1, at(4), 3, 4.0), (1, at(7), 4, 1.0), (2, at(3), 5, 2.0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in/one"))
    out = []
    stream = ingest.watch(spark, str(tmp_path / "in"), schema)
    ingest.run_once(stream, lambda df, n: out.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    ingest.run_once(stream, lambda df, n: out.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert out == [5]
    ingest.moment_sessions(stream).writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start().awaitTermination()
    got = sorted((r["round_id"], r["n_states"], r["score"]) for r in spark.table("found").collect())
    assert got == [(1, 1, 1.0), (1, 3, 3.0), (2, 1, 2.0)]


def test_blobs(spark):
    from tacgrid.sources import blobs as B

    player = dict(slot=3, side="CT", alive=True, x=2.5, y=-40000.0, z=7.4, health=88, place=None, node=12, yaw=-90.0, armor=300, money=70000, flash_s=1.26, primary=4, secondary=None, util=0x84)
    packed = B.pack_snapshot([player])
    got = dict(zip(B.FIELDS, B.unpack_snapshot(packed)[0], strict=True))
    assert len(packed) == 181 and (got["x"], got["y"], got["z"], got["armor"], got["money"], got["flash_s"]) == (2.0, -32768.0, 7.0, 255, 65535, 1.2)
    assert got["yaw"] == pytest.approx(270, abs=1) and got["place"] is None and got["node"] == 12 and got["secondary"] is None and got["alive"]
    import numpy as np

    for kind, yaw in ((B.V2, 127 / 255 * 360), (B.V1, None)):
        rows = np.zeros(10, kind)
        rows[9] = (1.5, 2.5, -3.5, 4 | 1, 50, 255, 7, 127, 0)[: len(kind.names)]
        old = B.unpack_snapshot(rows.tobytes())
        assert [(r[0], r[1], r[2], r[3], r[8], r[10]) for r in old] == [(9, "T", True, 1.5, 7, None)] and old[0][9] == (None if yaw is None else pytest.approx(yaw))
    path = B.pack_path([dict(t=1.234, x=1.5, y=2.5, z=-7.0), dict(t=999.0, x=0, y=0, z=0)])
    assert B.unpack_path(path) == [(1.23, 2.0, 2.0, -7.0), (655.35, 0.0, 0.0, 0.0)]
    assert B.unpack_path(np.array([1.26, 2, 3, 4], "<f4").tobytes()) == [(1.3, 2.0, 3.0, 4.0)] and B.unpack_path(b"") is None and B.unpack_path(b"xyz") is None
    token = bytes([1, 2, 255, 255, 255, 9, 10, 11, 12, 254])
    df = spark.createDataFrame([(bytearray(packed), bytearray(path), bytearray(token)), (None, None, None), (bytearray(b"odd"), bytearray(b"odd"), bytearray(token))], "s binary, p binary, t binary")
    rows = df.select(B.players_of(F.col("s")).alias("s"), B.path_of(F.col("p")).alias("p"), F.array(*B.token_of(F.col("t"))).alias("t")).collect()
    assert rows[0]["s"][0]["node"] == 12 and rows[0]["p"][0]["t"] == 1.23 and rows[0]["t"] == [1, 2, None, None, None, 9, 10, 11, 12, 254]
    assert rows[1]["s"] is None and rows[2]["s"] is None and rows[2]["p"] is None


def test_round_document(spark):
    from tacgrid.plans import document as D

    rounds_ = spark.createDataFrame([(1, 7, "CT")], "round_id long, recording_id long, winner string")
    snaps = spark.createDataFrame([(1, 64 * s, s, False, [(0, "CT", True, 1.26, 2.0), (5, "T", True, 0.0, 0.0)], 3.14, None) for s in (2, 1)], "round_id long, tick long, sec int, planted boolean, players array<struct<slot:int,side:string,alive:boolean,x:double,y:double>>, bomb_x double, bomb_y double")
    kills = spark.createDataFrame([(1, 1, 70, "ann", "T", "bob", None)], "round_id long, kill_id long, tick long, attacker string, attacker_side string, victim string, victim_side string")
    pieces = spark.createDataFrame([(1, 4, "smoke", 3, None)], "round_id long, util_id long, kind string, t_start int, t_end int")
    shots_ = spark.createDataFrame([(1, [(64, 3), (32, 1)])], "round_id long, shots array<struct<rel:int,slot:int>>")
    roster_ = spark.createDataFrame([(7, 0, "ann"), (7, 5, "bob")], "recording_id long, slot int, name string")
    doc = D.round_document(1, rounds_, snaps, kills, pieces, shots_, roster_, lambda r: r.select(F.lit(3).alias("ct_score")))
    assert [f["t"] for f in doc["frames"]] == [1, 2] and doc["frames"][0]["players"][1]["name"] == "bob" and doc["frames"][0]["bomb_x"] == 3.1
    assert doc["kills"][0]["attacker_side"] == "CT" and doc["kills"][0]["victim_side"] == "T" and doc["shots"] == [[0.5, 1], [1.0, 3]] and doc["round"]["ct_score"] == 3
    with pytest.raises(KeyError):
        D.round_document(2, rounds_, snaps, kills, pieces, shots_, roster_)
    rows = [("a", "b", None, None), ("CT", "b", "core", None), ("ct", "", None, None), ("a", None, None, None), (None, "T", None, "k")]
    keys = spark.createDataFrame(rows, "ct string, t string, cl string, tl string").select(*(c.alias(n) for c, n in zip(D.score_keys(F.col("ct"), F.col("t"), F.col("cl"), F.col("tl")), "ab", strict=True))).collect()
    plain = [tuple(tuple(k) if k else None for k in r) for r in keys]
    assert plain == [(("team", "a"), ("team", "b")), (("team", "core"), ("team", "b")), (None, None), (("team", "a"), ("opponent", "a")), (("opponent", "k"), ("team", "k"))]


def test_stats_document(spark):
    """Round 1 matches exactly, 2 closely, 3 only the filters; a second of round 1 comes twice."""
    from tacgrid.plans import document as D

    rows = [(1, 11, 25, False, True, True), (1, 10, 8, False, True, True), (1, 10, 8, False, False, False), (1, 12, 130, True, True, True), (2, 20, 9, False, True, False), (3, 30, 9, False, False, False)]
    states = spark.createDataFrame(rows, "round_id long, state_id long, sec int, planted boolean, in_match boolean, in_exact boolean").withColumn("in_baseline", F.lit(True))
    about = [(1, 7, "CT", "bomb_exploded", "a", None, "eco", "full"), (2, 7, "T", "ct_killed", "a", "b", "eco", "eco"), (3, 8, None, None, None, None, None, None)]
    rounds_ = spark.createDataFrame(about, "round_id long, recording_id long, winner string, win_reason string, ct_team string, t_team string, ct_buy string, t_buy string")
    kills = spark.createDataFrame([(1, 1, 500, 8, "CT"), (2, 1, 700, 12, "T"), (3, 2, 700, 12, "T")], "kill_id long, round_id long, tick long, round_sec int, victim_side string")
    doc = D.stats_document(states, rounds_, kills)
    assert doc["rounds"] == {"exact": 1, "close": 1, "baseline": 3, "recordings": 1}
    assert doc["winrate"] == {"exact": {"ct": 1, "t": 0}, "close": {"ct": 0, "t": 1}, "baseline": {"ct": 1, "t": 1}}
    assert doc["timing"]["pre"] == [1, 0, 1, *[0] * 9] and doc["timing"]["post_plant"] == 1
    assert doc["economy"]["ct"] == {"eco": 1, "semi": 0, "full": 0, "pistol": 0} and doc["economy"]["t"]["full"] == 1
    assert doc["win_reasons"]["ct"]["unknown"] == 1 and sum(doc["win_reasons"]["t"].values()) == 0
    assert doc["teams"] == {"ct": [{"name": "a", "rounds": 1}], "t": []} and doc["next_kill"] == {"ct": 1, "t": 0, "none": 0, "median_s": 4}
    none = D.stats_document(states.where("false"), rounds_, kills.where("false"))
    assert none["rounds"] == {"exact": 0, "close": 0, "baseline": 0, "recordings": 0} and none["next_kill"]["median_s"] is None and none["timing"]["pre"] == [0] * 12


def test_resolve_levels(spark):
    raster = spark.createDataFrame([("m", 0, 0, 0, 5, 100.0, 0.0, 0.0, 9, 9), ("m", 0, 0, 1, 6, -300.0, 0.0, 0.0, 9, 9)], navmesh.RASTER)
    points = spark.createDataFrame([("m", 1.0, 1.0, v) for v in ("lower", "upper", None)] + [("m", 99.0, 1.0, None)], "map_name string, x double, y double, level string")
    got = {(r["x"], r["level"]): r["node"] for r in navmesh.resolve(points, raster, -50.0).collect()}
    assert got == {(1.0, "lower"): 6, (1.0, "upper"): 5, (1.0, None): 5, (99.0, None): None}
    assert {r["node"] for r in navmesh.resolve(points.where("x < 2"), raster).collect()} == {5}
