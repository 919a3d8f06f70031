"""SQL that derives the telemetry of tacgrid.fixture, as common table expressions, and helpers to use it."""

from __future__ import annotations

import re
from itertools import permutations

SLOTS = ", ".join(f"({k})" for k in range(10))
_NODE = "CAST((s.p * (k.slot + 3) + s.s * (7 * k.slot + 1) + s.n * 13) % 120 AS INT)"

TABLES = {
    "recordings": """SELECT c_custkey AS recording_id, CAST(c_nationkey % 4 AS INT) AS map_id,
        'team_' || CAST(c_nationkey AS VARCHAR) AS team_a, 'team_' || CAST((c_custkey * 7 + 1) % 25 AS VARCHAR) AS team_b,
        c_nationkey AS nation FROM customer""",
    "plain_rounds": """SELECT o_orderkey AS round_id, o_custkey AS recording_id,
        CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS round_no,
        CASE o_orderstatus WHEN 'F' THEN 'CT' WHEN 'O' THEN 'T' END AS winner,
        CASE o_orderstatus
          WHEN 'F' THEN CASE o_orderkey % 4 WHEN 0 THEN 't_killed' WHEN 1 THEN 'bomb_defused' WHEN 2 THEN 'time_ran_out' END
          WHEN 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'ct_killed' WHEN 1 THEN 'bomb_exploded' END END AS win_reason,
        CAST(floor(o_totalprice) AS BIGINT) % 30000 AS ct_equip, o_orderkey * 7919 % 30000 AS t_equip,
        CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS site FROM orders""",
    "rounds": """SELECT r.*, c.map_id, c.nation, round_no IN (1, 13) AS is_pistol,
        CASE WHEN round_no IN (1, 13) THEN 'pistol' WHEN ct_equip <= 5000 THEN 'eco' WHEN ct_equip <= 16250 THEN 'semi' ELSE 'full' END AS ct_buy,
        CASE WHEN round_no IN (1, 13) THEN 'pistol' WHEN t_equip <= 5000 THEN 'eco' WHEN t_equip <= 16250 THEN 'semi' ELSE 'full' END AS t_buy,
        CASE WHEN round_no <= 12 THEN team_a ELSE team_b END AS ct_team,
        CASE WHEN CASE WHEN round_no <= 12 THEN team_a ELSE team_b END = team_a THEN team_b ELSE team_a END AS t_team
        FROM plain_rounds r JOIN recordings c USING (recording_id)""",
    "states": """SELECT l_orderkey * 10 + l_linenumber AS state_id, l_orderkey AS round_id, CAST(3 * l_linenumber + p % 3 AS INT) AS sec,
        p, s, CAST(l_linenumber AS BIGINT) AS n, l_linenumber >= 5 AS planted, rf, ls
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS rf, min(l_linestatus) AS ls
              FROM lineitem GROUP BY ALL)""",
    "players": f"""SELECT *, CAST((node % 12) * 100 + p % 41 - 20 AS DOUBLE) AS x, CAST((node // 12) * 100 + s % 31 - 15 AS DOUBLE) AS y
        FROM (SELECT s.state_id, s.round_id, s.sec, s.p, s.s, k.slot, CASE WHEN k.slot < 5 THEN 'CT' ELSE 'T' END AS side, {_NODE} AS node,
                     (s.p + 31 * k.slot + s.n) % 10 < 7 AS alive
              FROM states s CROSS JOIN (VALUES {SLOTS}) AS k(slot))""",
    "counts": """SELECT state_id, CAST(count(*) FILTER (alive AND side = 'CT') AS BIGINT) AS alive_ct,
        CAST(count(*) FILTER (alive AND side = 'T') AS BIGINT) AS alive_t FROM players GROUP BY state_id""",
    "utility": """SELECT *, CAST((node % 12) * 100 + p % 41 - 20 AS DOUBLE) AS x, CAST((node // 12) * 100 + s % 31 - 15 AS DOUBLE) AS y
        FROM (SELECT state_id AS util_id, round_id, CASE p % 4 WHEN 0 THEN 'smoke' ELSE 'molly' END AS kind, sec AS t_start,
                     CASE WHEN p % 9 = 0 THEN NULL ELSE CAST(sec + 1 + s % 6 AS INT) END AS t_end,
                     CAST((p * 3 + s + n * 13) % 120 AS INT) AS node, p, s
              FROM states WHERE p % 4 IN (0, 1))""",
    "active": """SELECT * FROM (SELECT st.state_id, u.kind, u.util_id, u.node, u.x, u.y,
               CAST(row_number() OVER (PARTITION BY st.state_id, u.kind ORDER BY u.util_id) AS INT) AS slot
        FROM states st JOIN utility u ON u.round_id = st.round_id AND st.sec BETWEEN u.t_start AND coalesce(u.t_end, u.t_start)) WHERE slot <= 10""",
    "idx": """SELECT st.*, r.* EXCLUDE (round_id), c.alive_ct, c.alive_t, coalesce(a.n_smoke, 0) AS n_smoke, coalesce(a.n_molly, 0) AS n_molly
        FROM states st JOIN rounds r ON r.round_id = st.round_id JOIN counts c ON c.state_id = st.state_id
        LEFT JOIN (SELECT state_id, count(*) FILTER (kind = 'smoke') AS n_smoke, count(*) FILTER (kind = 'molly') AS n_molly FROM active GROUP BY state_id) a
          ON a.state_id = st.state_id""",
    "geo": """SELECT CAST(a.n AS INT) AS na, CAST(b.n AS INT) AS nb, CAST(least(2000, 100 * (abs(a.n % 12 - b.n % 12)
          + CASE WHEN (a.n % 12 <= 5) = (b.n % 12 <= 5) THEN abs(a.n // 12 - b.n // 12) ELSE a.n // 12 + b.n // 12 END)) AS DOUBLE) AS d
        FROM range(120) a(n) CROSS JOIN range(120) b(n)""",
    "kills": """SELECT state_id AS kill_id, round_id, CAST(sec * 64 AS BIGINT) AS tick, sec AS round_sec,
        CASE WHEN p % 11 = 0 THEN NULL WHEN ls = 'O' THEN 'CT' ELSE 'T' END AS victim_side, CAST(p % 10 AS INT) AS attacker_slot,
        CAST((p + s) % 10 AS INT) AS victim_slot, CASE WHEN s % 4 = 0 THEN CAST(s % 10 AS INT) END AS assist_slot
        FROM states WHERE rf = 'R'""",
    "round_players": f"""SELECT r.round_id, r.recording_id, CAST(r.nation * 20 + k.slot + CASE WHEN r.round_id % 5 = 0 AND k.slot = 2 THEN 900 ELSE 0 END AS BIGINT) AS pid,
        CASE WHEN (k.slot < 5) = (r.round_no <= 12) THEN 'CT' ELSE 'T' END AS side, k.slot
        FROM rounds r CROSS JOIN (VALUES {SLOTS}) AS k(slot)""",
    "core_members": """SELECT CAST(g AS BIGINT) AS core_id, CAST(g * 20 + k AS BIGINT) AS pid FROM (SELECT DISTINCT nation AS g FROM recordings) CROSS JOIN (VALUES (0), (1), (2)) v(k)
        UNION ALL SELECT CAST(1000 + g AS BIGINT), CAST(g * 20 + k AS BIGINT) FROM (SELECT DISTINCT nation AS g FROM recordings WHERE nation % 3 = 0) CROSS JOIN (VALUES (1), (2), (3)) v(k)""",
    "matches": """SELECT rp.round_id, rp.side, m.core_id FROM round_players rp JOIN core_members m USING (pid) GROUP BY ALL HAVING count(DISTINCT rp.pid) = 3""",
    "parts": """SELECT recording_id, CASE WHEN recording_id % 7 <> 0 THEN 'match-' || CAST(recording_id // 3 AS VARCHAR) END AS prefix,
        CASE WHEN recording_id % 7 <> 0 THEN CAST(recording_id % 3 + 1 AS INT) END AS part, CASE WHEN recording_id // 3 % 5 <> 0 THEN '2026-01-01' END AS day FROM recordings""",
    "match_of": """SELECT recording_id, CASE WHEN prefix IS NULL THEN recording_id ELSE
          first_value(recording_id) OVER (PARTITION BY prefix, day ORDER BY part, recording_id) END AS match_id FROM parts""",
    "numbered": """SELECT r.round_id, r.recording_id, CAST(CASE WHEN p.prefix IS NULL THEN r.round_no ELSE
          row_number() OVER (PARTITION BY p.prefix, p.day ORDER BY p.part, r.recording_id, r.round_no) END AS INT) AS match_round
        FROM plain_rounds r JOIN parts p USING (recording_id)""",
    "ev": "SELECT event_id, user_id AS recording_id, CAST(floor(epoch(ts)) AS BIGINT) AS tick, event_id % 7 AS kind FROM events",
    "live": "SELECT recording_id, max(tick) AS live FROM ev WHERE kind = 6 AND event_id % 5 = 0 AND recording_id % 4 = 0 GROUP BY recording_id",
    "built": """SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY end_tick) AS INT) AS round_no FROM (
        SELECT e.recording_id, e.tick AS end_tick, e.winner, max(f.tick) AS freeze
        FROM (SELECT *, coalesce(lag(tick) OVER (PARTITION BY recording_id ORDER BY tick, winner), live) AS before FROM (
                SELECT x.recording_id, x.tick, CASE x.event_id % 3 WHEN 0 THEN 'CT' WHEN 1 THEN 'T' END AS winner, coalesce(l.live, 0) AS live
                FROM ev x LEFT JOIN live l ON l.recording_id = x.recording_id WHERE x.kind = 3) WHERE winner IS NOT NULL AND tick > live) e
        JOIN (SELECT recording_id, tick FROM ev WHERE kind = 0 AND event_id % 5 <> 0) f
          ON f.recording_id = e.recording_id AND f.tick >= e.before AND f.tick < e.tick
        GROUP BY ALL) WHERE end_tick - "freeze" >= 640""",
    "timed": "SELECT round_id, round_id % 3 * 64 AS freeze, CAST(round_id % 3 * 64 + max(sec) * 64 + 1 AS BIGINT) AS end_tick FROM states GROUP BY round_id",
}


def with_tables(body: str, **more: str) -> str:
    """body with the tables that it and they name, in order; more: further tables, after the others."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in TABLES:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                wanted.add(name)
                need(TABLES[name])

    need(body)
    for text in more.values():
        need(text)
    parts = [f"{n} AS ({TABLES[n]})" for n in TABLES if n in wanted] + [f"{n} AS ({t})" for n, t in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def chamfer(markers, side: str, prefix: str = "") -> str:
    """A table (state_id, cost) of the mean over the markers of one side."""
    own = [m for m in markers if m.kind == side]
    each = ", ".join(f"({i}, {m.node})" for i, m in enumerate(own))
    return f"""SELECT state_id, avg(least(d, 2000.0)) AS cost FROM (
        SELECT st.state_id, v.i, coalesce(min(g.d), 2000.0) AS d FROM states st CROSS JOIN (VALUES {each}) v(i, node)
        LEFT JOIN players p ON p.state_id = st.state_id AND p.side = '{side}' AND p.alive
        LEFT JOIN geo g ON g.na = v.node AND g.nb = p.node GROUP BY ALL) GROUP BY state_id"""


def ways(k: int, most: int = 5) -> list[tuple[int, int, int, int]]:
    """(players m, choice, marker, player): every way to give the first min(k, m) markers a player of its own."""
    out = []
    for m in range(1, most + 1):
        for c, players in enumerate(permutations(range(m), min(k, m))):
            out += [(m, c, i, j) for i, j in enumerate(players)]
    return out


def assignment(markers, side: str, hits: str) -> str:
    """A table (state_id, cost) of the best assignment over the states of hits."""
    own = [m for m in markers if m.kind == side]
    k = len(own)
    rows = ", ".join(map(str, ways(k)))
    each = ", ".join(f"({i}, {m.node}, {m.x}, {m.y})" for i, m in enumerate(own))
    return f"""SELECT h.state_id, coalesce(c.cost, 2000.0) AS cost FROM {hits} h LEFT JOIN (
        SELECT state_id, (min(total) + 2000.0 * greatest({k} - m, 0)) / {k} AS cost FROM (
          SELECT q.state_id, q.m, t.choice, sum(greatest(g.d, sqrt((q.x - v.x) * (q.x - v.x) + (q.y - v.y) * (q.y - v.y)))) AS total
          FROM (SELECT state_id, node, x, y, row_number() OVER (PARTITION BY state_id ORDER BY slot) - 1 AS j, count(*) OVER (PARTITION BY state_id) AS m
                FROM players WHERE alive AND side = '{side}' AND state_id IN (SELECT state_id FROM {hits})) q
          JOIN (VALUES {rows}) t(m, choice, i, j) ON t.m = q.m AND t.j = q.j JOIN (VALUES {each}) v(i, node, x, y) ON v.i = t.i
          JOIN geo g ON g.na = v.node AND g.nb = q.node GROUP BY ALL) GROUP BY state_id, m) c ON c.state_id = h.state_id"""


def runs(source: str) -> str:
    """Moments of a table (round_id, sec, state_id, score, cost)."""
    return f"""SELECT round_id, min(sec) AS t_start, max(sec) AS t_end, min(struct_pack(a := score, b := sec, c := state_id)).a AS score,
        min(struct_pack(a := score, b := sec, c := state_id)).c AS state_id, min(cost) AS node_cost, count(*) AS n_states, min(cost) <= 1e-6 AS exact
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY round_id ORDER BY sec, state_id) AS island FROM (
          SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY round_id ORDER BY sec, state_id) > 2 THEN 1 ELSE 0 END AS fresh FROM {source}))
        GROUP BY round_id, island"""
