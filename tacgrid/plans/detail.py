"""Further named queries: scalar functions, encodings, geometry and lookups over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tacgrid import fixture as X
from tacgrid.functions import scalar as S
from tacgrid.operators import catalog, navmesh, playback, rounds, teams
from tacgrid.plans import oracle as O
from tacgrid.plans.queries import _STEPS as MESH_STEPS
from tacgrid.plans.queries import _squared, built_rounds, grid_raster, query
from tacgrid.sources import blobs, files, navjson, store
from tacgrid.sources.scratch import shared_folder


@query(r"""SELECT c, nullif(replace(regexp_extract(f, '(?i)^(.+?)-vs-(.+?)-m\d', 1), '-', ' '), '') AS team_a, nullif(replace(regexp_extract(f, '(?i)^(.+?)-vs-(.+?)-m\d', 2), '-', ' '), '') AS team_b,
  CASE WHEN length(t) BETWEEN 1 AND 60 THEN t END AS tidy, regexp_matches(p, '^[0-9]{17}$') AND p <> '00000000000000000' AS valid, coalesce(c % 10 * 100.0 / nullif(c % 3, 0), 0.0)::DOUBLE AS pct, n[1] AS first_name, n[2] AS second_name
FROM (SELECT c, f, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t, p, list_sort(list_distinct(list_filter(list_transform([' b' || c % 3, '', 'a' || c % 4, 'b' || c % 3, NULL], lambda x: trim(x)), lambda x: x <> ''))) AS n FROM (
  SELECT c_custkey AS c, CASE WHEN c_custkey % 2 = 0 THEN 'Team-' || c_custkey % 5 || CASE WHEN c_custkey % 3 = 0 THEN '-VS-' ELSE '-vs-' END || 'Other-' || c_custkey % 7 || '-m' || c_custkey % 4 || '-x.dem' ELSE 'solo-' || c_custkey || '.dem' END AS f,
    CASE WHEN c_custkey % 13 = 0 THEN '   ' WHEN c_custkey % 17 = 0 THEN repeat('ab ', 30) ELSE '  core ' || chr(9) || ' ' || c_custkey % 11 || '  x ' END AS raw,
    CASE c_custkey % 4 WHEN 0 THEN '7656119' || lpad(c_custkey::VARCHAR, 10, '0') WHEN 1 THEN '00000000000000000' WHEN 2 THEN lpad(c_custkey::VARCHAR, 16, '7') ELSE 'x' || lpad(c_custkey::VARCHAR, 16, '7') END AS p FROM customer))""")
def text_functions(spark, d):
    """Teams of file names, tidy names, players' ids, percentages, first names."""
    c = F.col("c_custkey")
    s = lambda x: x.cast("string")
    vs = F.when(c % 3 == 0, "-VS-").otherwise("-vs-")
    name = F.when(c % 2 == 0, F.concat(F.lit("Team-"), s(c % 5), vs, F.lit("Other-"), s(c % 7), F.lit("-m"), s(c % 4), F.lit("-x.dem"))).otherwise(F.concat(F.lit("solo-"), s(c), F.lit(".dem")))
    raw = F.when(c % 13 == 0, "   ").when(c % 17 == 0, F.repeat(F.lit("ab "), 30)).otherwise(F.concat(F.lit("  core \t "), s(c % 11), F.lit("  x ")))
    pid = F.when(c % 4 == 0, F.concat(F.lit("7656119"), F.lpad(s(c), 10, "0"))).when(c % 4 == 1, "0" * 17).when(c % 4 == 2, F.lpad(s(c), 16, "7")).otherwise(F.concat(F.lit("x"), F.lpad(s(c), 16, "7")))
    names = F.array(F.concat(F.lit(" b"), s(c % 3)), F.lit(""), F.concat(F.lit("a"), s(c % 4)), F.concat(F.lit("b"), s(c % 3)), F.lit(None).cast("string"))
    team_a, team_b = S.teams_from_file(name)
    first, second = S.first_teams(names)
    return spark.read.parquet(f"{d}/customer.parquet").select(c.alias("c"), team_a.alias("team_a"), team_b.alias("team_b"), S.tidy_name(raw).alias("tidy"), S.valid_player(pid).alias("valid"), S.percent(c % 10, c % 3).alias("pct"), first.alias("first_name"), second.alias("second_name"))


_ITEMS = ("AK-47", "AWP", "USP-S", "Zeus x27", "Flashbang", "Smoke Grenade", "Molotov", "C4 Explosive", "Decoy Grenade", "High Explosive Grenade", "Incendiary Grenade", "Glock-18")
_STEPS = (1, 3, 5, 7, 11, 2)


@query(f"""SELECT p, CASE list_filter(i, lambda x: x IN ('AK-47', 'AWP'))[-1] WHEN 'AK-47' THEN 'ak47' WHEN 'AWP' THEN 'awp' END AS "primary",
  coalesce(CASE list_filter(i, lambda x: x IN ('USP-S', 'Glock-18'))[-1] WHEN 'USP-S' THEN 'usp_silencer' WHEN 'Glock-18' THEN 'glock' END, CASE WHEN list_contains(i, 'Zeus x27') THEN 'taser' END) AS secondary,
  least(len(list_filter(i, lambda x: x = 'Flashbang')), 3)::INT AS flashes, list_contains(i, 'Smoke Grenade') AS smoke, list_contains(i, 'High Explosive Grenade') AS he,
  list_contains(i, 'Molotov') OR list_contains(i, 'Incendiary Grenade') AS molly, list_contains(i, 'Decoy Grenade') AS decoy, list_contains(i, 'C4 Explosive') AS bomb
FROM (SELECT p_partkey AS p, [{', '.join(f"{list(_ITEMS)}[(p_partkey * {k} + p_size) % 12 + 1]" for k in _STEPS)}] AS i FROM part)""")
def inventory_flags(spark, d):
    """What players carry, from lists of six things."""
    p = F.col("p_partkey")
    items = F.array(*(F.get(F.array(*map(F.lit, _ITEMS)), ((p * k + F.col("p_size")) % 12).cast("int")) for k in _STEPS))
    return spark.read.parquet(f"{d}/part.parquet").select(p.alias("p"), items.alias("i")).select("p", S.inventory(F.col("i")).alias("v"), S.has_bomb(F.col("i")).alias("bomb")).select("p", "v.*", "bomb")


@query(O.with_tables("SELECT round_id, string_agg(CAST(sec AS VARCHAR), ',' ORDER BY sec) FILTER ((i - 1) % 4 = 0 OR i = n) AS path FROM (SELECT round_id, sec, row_number() OVER (PARTITION BY round_id ORDER BY sec) AS i, count(*) OVER (PARTITION BY round_id) AS n FROM states) GROUP BY ALL"))
def paths_thinned(spark, d):
    path = F.sort_array(F.collect_list("sec"))
    return X.states(spark, d).groupBy("round_id").agg(path.alias("path")).select("round_id", F.array_join(F.transform(S.thin_path(F.col("path")), lambda s: s.cast("string")), ",").alias("path"))


@query(O.with_tables("""SELECT recording_id * 1000 + round_no AS round_id, round_even(rel / 64.0, 2)::DOUBLE AS seconds, slot FROM (
  SELECT b.recording_id, b.round_no, e.tick - b.freeze AS rel, e.event_id % 4 AS slot FROM ev e JOIN built b ON b.recording_id = e.recording_id AND e.tick BETWEEN b.freeze AND b.end_tick
  WHERE e.kind IN (4, 6) AND e.event_id % 4 < 3 AND e.tick - b.freeze <= 65535)"""))
def shots_decoded(spark, d):
    fire = X.events(spark, d).where("kind IN (4, 6)").select("recording_id", "tick", F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("player"), F.lit("weapon_awp").alias("weapon"))
    slots = X.recordings(spark, d).select("recording_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot")).select("recording_id", F.concat(F.lit("p"), F.col("slot").cast("string")).alias("player"), "slot")
    return playback.decode_shots(rounds.shots(fire, built_rounds(spark, d), slots)).select("round_id", "seconds", F.col("slot").cast("long").alias("slot"))


_USUAL = "SELECT round_id, s % 7 AS player, CASE WHEN count(*) FILTER (p % 2 = 0) > count(*) FILTER (p % 2 = 1) THEN 'CT' ELSE 'T' END AS side FROM states GROUP BY ALL"


@query(O.with_tables("SELECT k.kill_id, coalesce(a.side, k.aside) AS attacker_side, coalesce(v.side, k.vside) AS victim_side FROM (SELECT kill_id, round_id, attacker_slot % 9 AS attacker, victim_slot % 9 AS victim, CASE WHEN attacker_slot < 5 THEN 'CT' ELSE 'T' END AS aside, victim_side AS vside FROM kills) k LEFT JOIN u a ON a.round_id = k.round_id AND a.player = k.attacker LEFT JOIN u v ON v.round_id = k.round_id AND v.player = k.victim", u=_USUAL))
def sides_repaired(spark, d):
    """Kills whose sides follow what the players mostly were in the round; who isn't seen keeps the event's."""
    own = X.kills(spark, d).select("kill_id", "round_id", (F.col("attacker_slot") % 9).cast("long").alias("attacker"), (F.col("victim_slot") % 9).cast("long").alias("victim"), F.when(F.col("attacker_slot") < 5, "CT").otherwise("T").alias("attacker_side"), "victim_side")
    frames = X.states(spark, d).select("round_id", (F.col("s") % 7).alias("player"), F.when(F.col("p") % 2 == 0, "CT").otherwise("T").alias("side"))
    return playback.repair_sides(own, frames).select("kill_id", "attacker_side", "victim_side")


@query(O.with_tables("SELECT e.event_id, b.round_no FROM ev e JOIN built b ON b.recording_id = e.recording_id AND e.tick >= b.freeze AND e.tick < b.end_tick QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY b.freeze DESC) = 1"))
def samples_in_rounds(spark, d):
    """Samples belong to a round up to before its last tick; ends of rounds are among them."""
    return rounds.attach_round(X.events(spark, d), built_rounds(spark, d).select("recording_id", "round_no", "freeze", "end_tick"), ["recording_id"], inclusive=False).select("event_id", "round_no")


@query("""SELECT recording_id, path FROM (SELECT r.p_partkey AS recording_id, f.path, row_number() OVER (PARTITION BY r.p_partkey ORDER BY coalesce(f.k = r.p_partkey % 5, false) DESC, f.path) AS n
  FROM part r JOIN (SELECT 'name_' || p_partkey % 40 AS name, p_size AS size, 'dir/' || p_partkey AS path, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 5 END AS k FROM part WHERE p_partkey % 2 = 0) f
  ON f.name = 'name_' || r.p_partkey % 40 AND f.size = r.p_size) WHERE n = 1""")
def files_resolved(spark, d):
    """The file of each recording: of equal name and size, of several the one of equal content."""
    p = F.col("p_partkey")
    part = spark.read.parquet(f"{d}/part.parquet")
    name, key = F.concat(F.lit("name_"), (p % 40).cast("string")), (p % 5).cast("string")
    found = part.where("p_partkey % 2 = 0").select(name.alias("name"), F.col("p_size").alias("size"), F.concat(F.lit("dir/"), p.cast("string")).alias("path"), F.when(p % 6 != 0, key).alias("content_key"))
    return files.resolve(part.select(p.alias("recording_id"), name.alias("name"), F.col("p_size").alias("size"), key.alias("content_key")), found)


_POLYGON = ((100.0, 100.0), (900.0, 150.0), (700.0, 500.0), (950.0, 850.0), (200.0, 700.0))
_EDGES = list(zip(_POLYGON, (_POLYGON[-1], *_POLYGON[:-1]), strict=True))


@query(O.with_tables(f"""SELECT state_id, slot, ({' + '.join(f"CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1]} - {a[1]})::DOUBLE + {a[0]} THEN 1 ELSE 0 END" for a, b in _EDGES)}) % 2 = 1 AS inside,
  (x + 500.0) / 4.0 AS px, (1500.0 - y) / 4.0 AS py FROM players"""))
def places_in_polygon(spark, d):
    """Players inside a polygon with a dent, and their pixels on an image of the map."""
    px, py = S.world_to_pixel(F.col("x"), F.col("y"), -500.0, 1500.0, 4.0)
    return X.players(spark, d).select("state_id", "slot", S.inside_polygon(F.col("x"), F.col("y"), list(_POLYGON)).alias("inside"), px.alias("px"), py.alias("py"))


_CELLS = "SELECT i.n AS ix, j.n AS iy, CAST(a.n AS INT) AS node, f.n AS layer, f.n * 200.0 AS z FROM range(90) i(n) CROSS JOIN range(90) j(n) JOIN range(120) a(n) ON (i.n + 0.5) * 16 - 32 >= a.n % 12 * 100 AND (i.n + 0.5) * 16 - 32 < a.n % 12 * 100 + 80 AND (j.n + 0.5) * 16 - 32 >= a.n // 12 * 100 AND (j.n + 0.5) * 16 - 32 < a.n // 12 * 100 + 80 JOIN range(2) f(n) ON f.n = 0 OR a.n % 5 = 0"


@query(O.with_tables("""SELECT p.state_id, p.slot, min(struct_pack(o := CASE WHEN p.level IS NULL OR ((c.z < 100) = (p.level = 'lower')) THEN 0 ELSE 1 END, l := c.layer, n := c.node)).n AS node
FROM (SELECT state_id, slot, trunc((x + 32) / 16) AS ix, trunc((y + 32) / 16) AS iy, CASE slot % 3 WHEN 1 THEN 'lower' WHEN 2 THEN 'upper' END AS level FROM players) p LEFT JOIN cells c ON c.ix = p.ix AND c.iy = p.iy GROUP BY ALL""", cells=_CELLS))
def points_on_levels(spark, d):
    """Points of a sketch on a map of two levels, with a wanted level or none."""
    level = F.when(F.col("slot") % 3 == 1, "lower").when(F.col("slot") % 3 == 2, "upper")
    points = X.players(spark, d).select(F.lit("grid").alias("map_name"), "state_id", "slot", "x", "y", level.alias("level"))
    return navmesh.resolve(points, grid_raster(spark), lower_max=100.0).select("state_id", "slot", "node")


def _little(value: Column, n: int = 2) -> Column:
    """Hex of a whole number's lowest n bytes, lowest first."""
    return F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(value.cast("int"), 8 * k).bitwiseAND(255).cast("long")), 2, "0") for k in range(n)))


@query(O.with_tables("""SELECT state_id, slot, side, alive, CAST(CAST(x AS SMALLINT) AS DOUBLE) AS x, CAST(CAST(y AS SMALLINT) AS DOUBLE) AS y, CASE WHEN node % 7 <> 0 THEN node END AS node, CAST(s % 101 AS INT) AS health, CAST(p % 16000 AS INT) AS money, p % 40 / 10.0::DOUBLE AS flash_s,
  s % 256 / 255.0::DOUBLE * 360 AS yaw FROM players WHERE slot <> state_id % 10"""))
def snapshots_unpacked(spark, d):
    """Packed snapshots of the newest version, made of all states, and unpacked; a slot in ten is empty."""
    p, s = F.col("p"), F.col("s")

    def slot(k: int) -> Column:
        node = X.node_of(k)
        flags = F.lit(4 | (2 if k < 5 else 0)) + X.alive_of(k).cast("int")
        one = F.concat(_little(X.place_x(node)), _little(X.place_y(node)), _little(F.lit(5)), *(_little(c, 1) for c in (flags, s % 101, F.lit(255), F.when(node % 7 == 0, 255).otherwise(node), s % 256, F.lit(100))), _little(p % 16000), *(_little(c, 1) for c in (p % 40, F.lit(3), F.lit(255), F.lit(0))))
        return F.when(F.col("state_id") % 10 == k, "00" * 18).otherwise(one)

    blob = F.unhex(F.concat(F.lit("03"), *(slot(k) for k in X.SLOTS)))
    rows = X.states(spark, d).select("state_id", F.inline(blobs.players_of(blob)))
    return rows.select("state_id", "slot", "side", "alive", "x", "y", "node", "health", "money", "flash_s", "yaw")


@query(O.with_tables("""SELECT round_id, string_agg(CAST(sec * 64 AS VARCHAR) || ':' || CAST(p % 5000 - 2500 AS VARCHAR) || ':' || CAST(s % 90 AS VARCHAR), ',' ORDER BY sec) AS path FROM states GROUP BY round_id"""))
def paths_unpacked(spark, d):
    """Packed flight paths of the newest version, a point for each state of a round."""
    point = F.concat(_little(F.col("sec") * 64), _little(F.col("p") % 5000 - 2500), _little(F.col("s") % 90), _little(F.lit(-7)))
    packed = X.states(spark, d).groupBy("round_id").agg(F.sort_array(F.collect_list(F.struct("sec", point.alias("h")))).alias("c"))
    blob = F.unhex(F.concat(F.lit("02"), F.array_join(F.transform("c", lambda x: x["h"]), "")))
    text = F.transform("path", lambda q: F.concat_ws(":", F.bround(q["t"] * 100).cast("long").cast("string"), q["x"].cast("long").cast("string"), q["y"].cast("long").cast("string")))
    return packed.select("round_id", blobs.path_of(blob).alias("path")).select("round_id", F.array_join(text, ",").alias("path"))


@query(O.with_tables("SELECT CASE recording_id % 6 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' WHEN 2 THEN 'alpha x' ELSE team_a END AS team, recording_id FROM (SELECT recording_id, CASE recording_id % 6 WHEN 3 THEN NULL ELSE team_a END AS team_a FROM recordings)"))
def teams_canonical(spark, d):
    """Teams by their own names, whatever the case of an alias."""
    r = F.col("recording_id") % 6
    names = X.recordings(spark, d).select("recording_id", F.when(r == 0, "ALPHA inc").when(r == 1, "beta").when(r == 2, "alpha x").when(r == 3, None).otherwise(F.col("team_a")).alias("team"))
    aliases = spark.createDataFrame([("Alpha Inc", "Alpha"), ("alpha inc", "Alpha"), ("BETA", "Beta")], "alias string, canonical string")
    return teams.canonical(names, aliases).select("team", "recording_id")


@query(O.with_tables("SELECT (SELECT count(*) FROM recordings) AS recordings, (SELECT count(*) FROM plain_rounds) AS rounds, (SELECT count(*) FROM states) AS states"))
def library_counts(spark, d):
    return catalog.counts(X.recordings(spark, d), X.plain_rounds(spark, d), X.states(spark, d))


@query(O.with_tables("SELECT recording_id, CASE WHEN t THEN 'cup_' || CAST(f % 7 AS VARCHAR) ELSE event END AS event, CASE WHEN t THEN CASE WHEN f % 2 = 0 THEN f END ELSE ref END AS match_ref FROM (SELECT *, f < 60 AND (event IS NULL OR ref IS NULL) AS t FROM (SELECT recording_id, recording_id % 90 AS f, CASE WHEN recording_id % 4 > 0 THEN 'own' END AS event, CASE WHEN recording_id % 3 > 0 THEN recording_id END AS ref FROM recordings))"))
def metadata_overlaid(spark, d):
    """Recordings that lack an event or a reference take both from an overlay by file name."""
    r = F.col("recording_id")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    own = X.recordings(spark, d).select("recording_id", name(r % 90).alias("file_name"), F.when(r % 4 > 0, "own").alias("event"), F.when(r % 3 > 0, r).alias("match_ref"))
    overlay = spark.range(60).select(name(F.col("id")).alias("file_name"), F.concat(F.lit("cup_"), (F.col("id") % 7).cast("string")).alias("event"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("match_ref"))
    return store.apply_metadata(own, overlay).select("recording_id", "event", "match_ref")


@query("SELECT 'k' || p_partkey AS content_key, 'error' AS status, substr(repeat('bad ' || p_partkey || ' ', 60), 1, 500) AS error FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 12 <> 0")
def failures_kept(spark, d):
    """Files that failed, but for those that are known; messages are cut."""
    p = F.col("p_partkey").cast("string")
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("k"), p).alias("content_key"), p.alias("path"), F.repeat(F.concat(F.lit("bad "), p, F.lit(" ")), 60).alias("message"))
    return store.quarantine(rows.where("p_partkey % 4 = 0"), rows.where("p_partkey % 3 = 0")).select("content_key", "status", "error")


@query("SELECT g AS recording_id, c, CASE WHEN g % 3 = 0 THEN 'new' ELSE 'old' END AS mark FROM (SELECT c_custkey % 40 AS g, c_custkey AS c FROM customer) WHERE g <> 7 AND (g % 3 <> 0 OR c // 40 % 2 = 0)")
def library_replaced(spark, d):
    """Forty recordings are written, a third of them again with fewer rows, and one is removed; what is read is what counts."""
    rows = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 40).alias("recording_id"), F.col("c_custkey").alias("c"))
    library = store.Library(spark, shared_folder(spark, "library"))
    old, new = rows.withColumn("mark", F.lit("old")), rows.where("recording_id % 3 = 0 AND c DIV 40 % 2 = 0").withColumn("mark", F.lit("new"))
    library.write_all({"rounds": old, "recordings": old.groupBy("recording_id").agg(F.count("*").alias("n"))})
    library.write_all({"rounds": new, "recordings": new.groupBy("recording_id").agg(F.count("*").alias("n"))})
    library.remove(7)
    return library.read("rounds").select("recording_id", "c", "mark")


@query(f"WITH {MESH_STEPS}{_squared(8)} SELECT a.m AS map_name, CAST(a.n AS INT) AS na, CAST(b.n AS INT) AS nb, least(coalesce(CAST(p.d AS DOUBLE), 4000.0), 4000.0) AS d FROM nodes a JOIN nodes b ON b.m = a.m LEFT JOIN d8 p ON p.m = a.m AND p.na = a.n AND p.nb = b.n")
def map_library(spark, d):
    """Distances of all maps, kept in a library and read back."""
    library = store.Library(spark, shared_folder(spark, "maps"))
    library.write_map({"geo": navmesh.geodesics(X.mesh_steps(spark, d))})
    return library.read("geo").select("map_name", "na", "nb", "d")


_MESH = """rows_ AS (SELECT *, row_number() OVER w - 1 AS j, lead(c, 1) OVER w AS r, lead(c, 12) OVER w AS b FROM (
    SELECT 'de_' || c_nationkey || '_' || c_custkey // 2500 AS m, c_custkey AS c FROM customer) WINDOW w AS (PARTITION BY m ORDER BY c)),
  areas AS (SELECT m AS map_name, c AS area_id, j, s * s AS size, px + s / 2 AS x, py + s / 2 AS y, z FROM (
    SELECT *, (j % 12 * 100 + c % 7 * 3)::DOUBLE AS px, (j // 12 * 100 + c % 5 * 4)::DOUBLE AS py, (c % 3 * 10 + 60)::DOUBLE AS s, CASE WHEN c % 6 = 0 THEN 200.0 ELSE c % 4 * 20.0 END::DOUBLE AS z FROM rows_)),
  links AS (SELECT m AS map_name, c AS a, r AS b FROM rows_ WHERE j % 12 < 11 AND c % 9 <> 0 AND r IS NOT NULL UNION ALL SELECT m, c, b FROM rows_ WHERE c % 7 <> 0 AND b IS NOT NULL)"""


def _as_json(spark, d) -> str:
    """The meshes of all maps as JSON, an object for each area; all link to one that isn't there, and as many again are no polygons."""
    areas, edges = X.meshes(spark, d)
    to = edges.groupBy("map_name", F.col("a").alias("area_id")).agg(F.collect_list("b").alias("connections"))
    corner = lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z"))
    rows = areas.join(to, ["map_name", "area_id"], "left").select("map_name", "area_id", F.transform("corners", lambda p: corner(p, F.col("z"))).alias("corners"), F.concat(F.coalesce("connections", F.array().cast("array<long>")), F.array(F.lit(-5).cast("long"))).alias("connections"))
    flat = rows.select("map_name", F.negate("area_id").alias("area_id"), F.slice("corners", 1, 2).alias("corners"), "connections")
    rows.union(flat).write.json(path := shared_folder(spark, "nav"))
    return path


@query(f"WITH {_MESH} SELECT map_name, area_id, size, x, y, z FROM areas")
def nav_areas(spark, d):
    """Areas of navigation meshes read from JSON, with size and centre."""
    return navjson.read_areas(spark, _as_json(spark, d)).select("map_name", "area_id", *(F.round(c, 6).alias(c) for c in ("size", "x", "y", "z")))


@query(f"WITH {_MESH} SELECT map_name, a, b FROM links UNION SELECT map_name, b, a FROM links")
def nav_links(spark, d):
    """Their links, in both directions."""
    return navjson.area_edges(navjson.read_areas(spark, _as_json(spark, d)))


_NODES = f"""{_MESH}, nodes AS (SELECT *, CAST(j // 4 AS INT) AS node FROM areas),
  centres AS (SELECT map_name, node, sum(x * size) / sum(size) AS x, sum(y * size) / sum(size) AS y, sum(z * size) / sum(size) AS z FROM nodes GROUP BY ALL)"""


def _by_fours(spark, d):
    areas, edges = X.meshes(spark, d)
    nodes = areas.select("map_name", "area_id", F.floor(F.col("node") / 4).cast("int").alias("node"))
    return navmesh.node_centres(areas.drop("node"), nodes), nodes, edges


@query(f"WITH {_NODES} SELECT map_name, node, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM centres")
def node_centres(spark, d):
    """Centres of nodes of four areas each, by their sizes."""
    return _by_fours(spark, d)[0].select("map_name", "node", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(f"WITH {_NODES}, pairs AS (SELECT DISTINCT l.map_name, p.node AS na, q.node AS nb FROM (SELECT * FROM links UNION SELECT map_name, b, a FROM links) l JOIN nodes p ON p.area_id = l.a JOIN nodes q ON q.area_id = l.b WHERE p.node <> q.node) SELECT map_name, na, nb, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS d FROM pairs JOIN (SELECT map_name, node AS na, x, y, z FROM centres) a USING (map_name, na) JOIN (SELECT map_name, node AS nb, x, y, z FROM centres) b USING (map_name, nb)")
def node_links(spark, d):
    """Linked nodes and how far apart they are."""
    centres, nodes, edges = _by_fours(spark, d)
    return navmesh.node_edges(edges, nodes, centres).select("map_name", "na", "nb", F.round("d", 6).alias("d"))


@query(O.with_tables("""SELECT state_id, CASE WHEN sec >= 9 AND round_id % 3 = 0 THEN 1.0 * (round_id % 50) ELSE cx END AS bomb_x, CASE WHEN sec >= 9 AND round_id % 3 = 0 THEN 2.0 * (round_id % 50) ELSE cy END AS bomb_y
FROM (SELECT state_id, round_id, sec, last_value(CASE WHEN p % 3 = 0 THEN CAST(p % 100 AS DOUBLE) END IGNORE NULLS) OVER w AS cx, last_value(CASE WHEN p % 3 = 0 THEN CAST(s % 100 AS DOUBLE) END IGNORE NULLS) OVER w AS cy FROM states WINDOW w AS (PARTITION BY round_id ORDER BY sec ROWS UNBOUNDED PRECEDING))"""))
def bomb_planted_place(spark, d):
    """Where the bomb is: its carrier's last place, the plant's once it is planted and its place known."""
    seen = lambda c: F.when(F.col("p") % 3 == 0, (F.col(c) % 100).cast("double"))
    samples = X.states(spark, d).select("state_id", "round_id", F.col("sec").alias("tick"), seen("p").alias("carrier_x"), seen("s").alias("carrier_y"))
    r = F.col("round_id")
    known = lambda k: F.when(r % 3 == 0, (r % 50 * k).cast("double"))
    plants = X.plain_rounds(spark, d).where("round_id % 3 < 2").select("round_id", F.lit(9).alias("plant_tick"), known(1).alias("plant_x"), known(2).alias("plant_y"))
    return rounds.carry_forward(samples, plants).select("state_id", "bomb_x", "bomb_y")
