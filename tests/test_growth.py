"""Work that must not grow faster than the tables: rows that any step of a plan makes, and rows that are moved."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tacgrid import fixture as X
from tacgrid.operators import navmesh, utility
from tacgrid.plans import queries
from tacgrid.sources import files
from test_sweeps import plain_match


def counted(frame, *names: str) -> list[tuple[str, int]]:
    """(step, value) of these metrics in the plan that frame ran by."""
    query = frame._jdf.queryExecution()
    query.toRdd().count()
    found, todo = [], [query.executedPlan()]
    while todo:
        step = todo.pop()
        kind = step.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(step.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(step.plan())
        for name in names:
            if step.metrics().contains(name):
                found.append((kind, step.metrics().apply(name).value()))
        todo += [step.children().apply(k) for k in range(step.children().size())]
    return found


def moved(frame) -> int:
    """Rows that all shuffles of the plan write."""
    return sum(n for _, n in counted(frame, "shuffleRecordsWritten"))


def test_files_of_one_name_are_not_paired(spark):
    """2,000 recordings and 2,000 files of one name and size."""
    n = F.col("id")
    key = F.when(n % 7 != 0, (n % 9).cast("string")).alias("content_key")
    there = spark.range(2000).select(F.lit("a").alias("name"), F.lit(1).alias("size"), F.concat(F.lit("p"), n.cast("string")).alias("path"), key)
    rows = spark.range(2000).select(n.alias("recording_id"), F.lit("a").alias("name"), F.lit(1).alias("size"), F.when(n % 5 != 0, (n % 11).cast("string")).alias("content_key"))
    found = files.resolve(rows, there)
    assert max(v for _, v in counted(found, "numOutputRows")) <= 4000
    first = {k: min(f"p{i}" for i in range(2000) if i % 7 and (k is None or i % 9 == k)) for k in range(9)}
    every = min(f"p{i}" for i in range(2000))
    assert {r["recording_id"]: r["path"] for r in found.collect()} == {i: first.get(i % 11, every) if i % 5 else every for i in range(2000)}


FOLDER = "/root/testdata/sf0.001"


def test_players_stay_with_their_states(spark):
    """A state's ten players are neither moved nor sorted, and only those that count are made."""
    n = X.states(spark, FOLDER).count()
    own = entry.queries()
    for name in ("named_players", "frames_tween", "frames_tween_all", "tick_slots", "tick_planted", "points_on_levels", "bomb_carrier", "vote_upsert", "zone_labels"):
        assert moved(own[name](spark, FOLDER)) < n, name
    for name in ("equipment_at_buy", "vote_upsert"):
        assert max(v for _, v in counted(own[name](spark, FOLDER), "numOutputRows")) <= 2 * n, name


def test_a_constant_polygon_is_plain_arithmetic(spark):
    """no list of edges is walked through for each player."""
    assert "lambda" not in entry.queries()["places_in_polygon"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_active_utility_meets_snapshots_by_round(spark):
    """lists as active_lists gives them, without a row for each state and piece, and no state is moved for them."""
    own, pieces = X.states(spark, FOLDER), X.utility(spark, FOLDER)
    plain = {r["state_id"]: (r["smokes"] or [], r["mollies"] or []) for r in utility.active_lists(own, pieces, cap=2).collect()}
    rows = utility.with_active(own, pieces, cap=2).collect()
    assert {r["state_id"]: (r["smokes"] or [], r["mollies"] or []) for r in rows} == {r["state_id"]: plain.get(r["state_id"], ([], [])) for r in rows}
    assert all((r["n_smoke"], r["n_molly"]) == (len(r["smokes"] or []), len(r["mollies"] or [])) for r in rows) and len(rows) == own.count()
    assert moved(queries.full_index(spark, FOLDER).select("state_id", "n_smoke", "n_molly")) < own.count()


def test_the_index_is_not_kept_beside_the_states(spark):
    """Of the index a search reads only the columns it needs; no copy of all of them is written."""
    assert not X.index(spark, FOLDER).is_cached and X.states(spark, FOLDER).is_cached


def test_maps_are_drawn_by_more_than_one_task_in_one_pass(spark):
    """maps go through Python once, and few bytes of them don't make one task."""
    found = queries.raster_dilate(spark, FOLDER)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.rdd.getNumPartitions() >= 8 and plan.count("FlatMapGroupsIn") == 1
    areas, _ = X.meshes(spark, FOLDER)
    apart = navmesh.dilate(navmesh.rasterise(areas))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, apart.collect()))


def test_tracks_are_matched_in_one_stream(spark):
    """recordings are told apart within a stream, across its batches, and don't go to Python one by one."""
    base = spark.range(3000)
    n = F.col("id")
    events = base.select((n % 1500).alias("recording_id"), F.lit("smoke").alias("kind"), n.alias("util_id"), (n % 7 * 100 + 10).alias("tick"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    tracks = base.select((n % 1500).alias("recording_id"), F.lit("smoke").alias("kind"), n.alias("track_id"), F.explode(F.array(n % 7 * 100, n % 7 * 100 + 5)).alias("tick"), (n % 5).cast("double").alias("x"), F.lit(0.0).alias("y"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = utility.match_tracks(events, tracks)
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" not in plan and "MapInArrow" in plan
    rows = lambda df, *columns: [tuple(r) for r in df.select(*columns).collect()]
    keys = ("recording_id", "kind")
    assert got == plain_match(rows(events, *keys, "util_id", "tick", "x", "y"), rows(tracks, *keys, "track_id", "tick", "x", "y")) and len(got) > 1500


def test_parts_of_states_grow_in_number(spark, monkeypatch):
    """a task by round holds no more of a larger table; neither moves nor sorts states anew."""
    monkeypatch.setattr(X, "LINES_OF_PART", 500)
    X.release(spark)
    try:
        want = sorted(map(tuple, spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().collect()))
        own = X.states(spark, FOLDER)
        assert own.rdd.getNumPartitions() >= 12
        assert sorted(map(tuple, own.select("round_id", F.col("n").cast("int")).collect())) == want
        found = queries.membership_new(spark, FOLDER)
        assert moved(found) < own.count() and found.rdd.getNumPartitions() >= 12
    finally:
        X.release(spark)
