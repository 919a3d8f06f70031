"""Queries over all rows, without SQL, against plain programs."""

import math
from itertools import permutations

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tacgrid import fixture as X
from tacgrid.operators import recall, rerank
from tacgrid.plans import queries as N
from tacgrid.plans import search as Q

FOLDER = "/root/testdata/sf0.001"


def grid(a, b):
    ax, ay, bx, by = a % 12, a // 12, b % 12, b // 12
    return min(2000.0, 100.0 * (abs(ax - bx) + (abs(ay - by) if (ax <= 5) == (bx <= 5) else ay + by)))


def test_every_state_is_reranked(spark):
    want = {}
    for r in X.nested_players(spark, FOLDER).collect():
        own = [p for p in r["players"] if p["alive"] and p["side"] == "CT"]
        n = min(3, len(own))
        cost = [[max(grid(m.node, p["node"]), math.hypot(p["x"] - m.x, p["y"] - m.y)) for p in own] for m in N.ON_CT]
        best = min(sum(cost[i][j] for i, j in enumerate(w)) for w in permutations(range(len(own)), n)) if own else 0.0
        want[r["state_id"]] = (best + 2000.0 * (3 - n)) / 3
    got = {r["state_id"]: r["cost"] for r in entry.queries()["assignment_rerank_all"](spark, FOLDER).collect()}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}
    assert len(got) == X.states(spark, FOLDER).count()


def test_every_player_is_tweened(spark):
    by = {}
    for r in X.players(spark, FOLDER).select("round_id", "slot", "sec", "x", "node").collect():
        by.setdefault((r[0], r[1]), []).append((float(r[2]), r[3], r[4] * 3.0))
    want = []
    for (game, slot), own in by.items():
        own.sort()
        for a, b in zip(own, [*own[1:], None]):
            for k in range(4 if b else 1):
                turn = ((b[2] - a[2] + 540.0) % 360.0 - 180.0) * k / 4 if b else 0.0
                yaw = (a[2] + turn) % 360.0 if b else a[2]
                want.append((game, slot, round(a[0] + ((b[0] - a[0]) * k / 4 if b else 0.0), 6), round(a[1] + ((b[1] - a[1]) * k / 4 if b else 0.0), 6), round(yaw, 6)))
    got = [(r["round_id"], r["player"], r["sec"], r["x"], r["yaw"]) for r in entry.queries()["frames_tween_all"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)
    assert {r[1] for r in got} == set(range(10))


def test_scalars_of_every_order(spark):
    got = {r["o_orderkey"]: r for r in entry.queries()["scalar_functions_all"](spark, FOLDER).collect()}
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_totalprice").collect()
    assert len(got) == len(orders)
    for o, price in orders:
        t, r, price = o % 150, got[o], float(price)
        assert (r["clock"], r["clock_left"]) == (f"{t // 60}:{t % 60:02d}", max(0, 115 - t))
        assert (r["side"], r["second"], r["q16"]) == ({3: "CT", 2: "T"}.get(o % 5), round(price / 64), max(-32768, min(32767, round(price - 100000))))
        assert r["yaw"] == round(price % 360 / 360.0 * 255.0)
    assert {"0:00", "1:00", "2:00"} & {r["clock"] for r in got.values()} and any(o % 150 > 115 for o in got)


GEO = recall.Geodesics({0: [0.0, 100.0, 400.0], 1: [100.0, 0.0, 300.0], 2: [400.0, 300.0, 0.0]}, 1000.0)


def test_rerank_on_two_floors(spark):
    """Straight-line distance counts on the marker's own floor alone; on the other one the geodesic does."""
    people = "array<struct<slot:int,side:string,alive:boolean,node:int,x:double,y:double,z:double>>"
    df = spark.createDataFrame([(1, -50.0), (2, 50.0)], "state_id long, z double")
    df = df.select("state_id", F.array(F.struct(F.lit(0).alias("node"), F.lit(300.0).alias("x"), F.lit(0.0).alias("y"), "z")).alias("smokes"), F.array(F.struct(F.lit(0).alias("slot"), F.lit("CT").alias("side"), F.lit(True).alias("alive"), F.lit(1).alias("node"), F.lit(300.0).alias("x"), F.lit(0.0).alias("y"), "z")).cast(people).alias("players"))

    def scores(level, lower_max, kinds):
        lib = Q.Library(df, lambda ids: df.select("state_id", "players"), None, {}, lower_max)
        request = Q.Request(tuple(recall.Marker(k, 0, 0.0, 0.0, level) for k in kinds))
        return {r["state_id"]: r["score"] for r in Q.rerank(lib, request, df.drop("players"), GEO).collect()}

    assert scores("lower", 0.0, ["CT"]) == {1: 300.0, 2: 100.0}
    assert scores("upper", 0.0, ["CT"]) == {1: 100.0, 2: 300.0}
    assert scores(None, 0.0, ["CT"]) == scores("lower", None, ["CT"]) == {1: 300.0, 2: 300.0}
    assert scores("lower", 0.0, ["smoke"]) == {2: 0.0}
    assert scores(None, 0.0, ["smoke"]) == {}


@pytest.mark.parametrize("k", [1, 3, 7])
def test_more_than_five_players(spark, k):
    marks = [recall.Marker("CT", i % 3, 60.0 * i, 5.0) for i in range(k)]
    people = {s: [((s * 7 + j * 5) % 3, 40.0 * ((s * j + s) % 9), 30.0 * (j % 4)) for j in range(m)] for s, m in enumerate((6, 7, 8, 6))}
    df = spark.createDataFrame(list(people.items()), "state_id long, p array<struct<node:int,x:double,y:double>>")

    def plain(players, own):
        n = min(len(own), len(players))
        cost = [[max(GEO.rows[q.node][p[0]], math.hypot(p[1] - q.x, p[2] - q.y)) for p in players] for q in own]
        return (min(sum(cost[i][j] for i, j in enumerate(w)) for w in permutations(range(len(players)), n)) + GEO.pad * (len(own) - n)) / len(own)

    got = {r[0]: r[1] for r in df.select("state_id", rerank.assignment_cost(F.col("p"), marks, GEO)).collect()}
    assert got == {s: pytest.approx(plain(own, marks)) for s, own in people.items()}
    assert len({tuple(own[:5]) for own in people.values()}) == len(people)
