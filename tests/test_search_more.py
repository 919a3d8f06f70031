"""The pruning index, pages of a kept search, and seconds of live rounds."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tacgrid import fixture as X
from tacgrid import params as P
from tacgrid.operators import pivots as V
from tacgrid.operators import recall, rounds
from tacgrid.plans import queries as N
from tacgrid.plans import search as Q
from tacgrid.streaming import live

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("tolerance", [300.0, 150.0, 50.0, 1500.0])
def test_pruned_recall_finds_the_same(spark, tolerance):
    request = Q.Request(tuple(N.MARKERS), tolerance=tolerance)
    pruned, _ = Q.population(N.pruned_library(spark, FOLDER), request)
    plain, _ = Q.population(N.library(spark, FOLDER, False), request)
    pick = lambda df: {(r.state_id, r.cost) for r in df.select("state_id", "cost").collect()}
    assert pick(pruned) == pick(plain)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = pruned.where("true")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(ct_lo_0" in plan and "GreaterThanOrEqual(t_hi_3" in plan  # the scan gets the bounds


def test_row_groups_fall_away(spark, tmp_path):
    """Fewer row groups the closer the search; none that holds a match."""
    geo, own = X.geo(spark), V.choose(X.geo(spark))
    assert len(set(own)) == 4
    rows = recall.Geodesics.read(geo, {*own, *(m.node for m in N.MARKERS)})
    V.write(V.with_bounds(X.index(spark, FOLDER), rows, own, X.tokens()), str(tmp_path / "index"), own, group_rows=200)
    left = [V.row_groups(str(tmp_path / "index"), V.comparisons(rows, N.MARKERS, own, t)) for t in (300.0, 150.0, 50.0)]
    assert left[0][1] > 200 and left[0][0] < left[0][1] and left[2][0] < left[1][0] < left[0][0]


def test_bounds_hold_where_a_side_is_dead_and_without_markers(spark):
    rows = recall.Geodesics({0: [0.0, 300.0, 900.0], 2: [900.0, 700.0, 0.0]}, 2000.0)
    index = spark.createDataFrame([(1, None, None), (2, 1, None), (3, 2, 0)], "state_id long, a int, b int")
    got = V.with_bounds(index, rows, [0, 2], {"CT": [F.col("a"), F.col("b")]}).orderBy("state_id").collect()
    assert [(r.ct_lo_0, r.ct_hi_0, r.ct_lo_1, r.ct_hi_1) for r in got] == [(0.0, 2000.0, 0.0, 2000.0), (300.0, 300.0, 700.0, 700.0), (0.0, 900.0, 0.0, 900.0)]
    assert V.reachable(rows, [], [0, 2]) is None


def test_pages_are_one_larger_limit(spark):
    lib = N.library(spark, FOLDER)
    for request in (N.FULL, Q.Request(filters=N.filters.Filters(bomb_planted=True))):
        whole = [tuple(r) for r in Q.search(lib, Q.Request(request.markers, request.filters, limit=95)).collect()]
        kept, pages, after = Q.Kept(lib, request), [], None
        for size in (30, 1, 50, 14):
            page = kept.page(size, after).collect()
            after = Q.Place.of(page[-1])
            pages += map(tuple, page)
        assert pages == whole and len(whole) == 95
        plan = kept.page(10, after)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("FileScan") == 1  # nothing is recalled again
        kept.drop()
    last = Q.Kept(lib, N.FULL, "last")
    end = last.page(10_000).collect()
    assert last.page(5, Q.Place.of(end[-1])).collect() == []
    last.drop()


def test_live_seconds_equal_the_batch(spark, tmp_path):
    """Rounds whose events come shuffled and late, in many small batches, and one that never starts."""
    rng = random.Random(6)
    base = datetime.datetime(2026, 1, 1)
    at = lambda tick: base + datetime.timedelta(seconds=tick / P.TICKRATE)
    schema = "round_id long, kind string, tick long, x double, y double, ts timestamp"
    events, samples, known = [], [], []
    for r in range(1, 7):
        freeze = rng.randrange(0, 3000)
        end = freeze + rng.choice([200, 321, 900, 2000])
        known.append((r, freeze, end))
        events += [(r, "freeze", freeze, None, None, at(freeze)), (r, "end", end, None, None, at(end))]
        for tick in sorted({*range(freeze - 32, end + 80, 16), freeze + 320, end - 1}):
            x, y = (float(rng.randrange(99)) if rng.random() < 0.4 else None for _ in range(2))
            samples.append((r, tick, x, y))
            events.append((r, "sample", tick, x, y, at(tick)))
    events.append((50, "sample", 100, 1.0, 1.0, at(100)))
    events.sort(key=lambda e: e[2] + rng.uniform(0, 9) * P.TICKRATE)  # up to nine seconds late
    batches = [events[i : i + 80] for i in range(0, len(events), 80)] + [[(99, "freeze", 99_999, None, None, at(99_999))]] * 2
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = live.live_seconds(stream).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    grid = rounds.resample(spark.createDataFrame(samples, "round_id long, tick long, carrier_x double, carrier_y double"), spark.createDataFrame(known, "round_id long, freeze long, end_tick long"))
    want = rounds.carry_forward(grid).select("round_id", "tick", "is_buy", "bomb_x", "bomb_y")
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, want.collect()))
    assert len([p for p in query.recentProgress if p.numInputRows]) > 3
