"""What runs along a stream or over a whole column against plain programs that go row by row."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tacgrid import params as P
from tacgrid.operators import playback, utility
from tacgrid.plans import queries as N
from tacgrid.sources import blobs as B
from tacgrid.sources import files

FOLDER = "/root/testdata/sf0.001"


def plain_match(events, samples):
    """Every detonation looks at all tracks that are left."""
    out = []
    keys = sorted({(e[0], e[1]) for e in events})
    for key in keys:
        left = {}
        for s in sorted((s for s in samples if s[:2] == key), key=lambda s: (s[3], s[4], s[5])):
            left.setdefault(s[2], []).append(s[3:])
        for e in sorted((e for e in events if e[:2] == key), key=lambda e: (e[3], e[2])):
            found = []
            for track, points in left.items():
                upto = [p for p in points if p[0] <= e[3]]
                if points[0][0] <= e[3] <= points[-1][0] + P.TRACK_MAX_TICKS and len(upto) >= 2:
                    away = math.hypot(upto[-1][1] - e[4], upto[-1][2] - e[5])
                    if away < P.TRACK_MAX_DISTANCE:
                        found.append((away, track, len(upto)))
            if found:
                best = min(found)
                left.pop(best[1])
                out.append((e[2], best[1], best[2]))
    return sorted(out)


DETONATIONS = "recording_id long, kind string, util_id long, tick long, x double, y double"
TRACKS = "recording_id long, kind string, track_id long, tick long, x double, y double"


@pytest.mark.parametrize("seed", range(4))
def test_tracks_are_swept_as_if_each_was_looked_at(spark, seed):
    """Places on a coarse grid, so that distances tie, and ticks that coincide."""
    rng = random.Random(seed)
    place = lambda: (rng.randrange(-3, 4) * 100.0, rng.randrange(-3, 4) * 100.0)
    tracks = [(r, kind, t, start + rng.randrange(0, 200), *place()) for r in (1, 2) for kind in ("smoke", "molly") for t in range(25) for start in [rng.randrange(1000)] for _ in range(rng.randrange(1, 7))]
    events = [(rng.choice((1, 2, 3)), rng.choice(("smoke", "molly")), u, rng.randrange(0, 1300), *place()) for u in range(120)]
    got = utility.match_tracks(spark.createDataFrame(events, DETONATIONS), spark.createDataFrame(tracks, TRACKS))
    want = plain_match(events, tracks)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_track_query_equals_plain(spark):
    own = N.track_inputs(spark, FOLDER)
    events, tracks = ([tuple(r) for r in df.select(*[c.split()[0] for c in schema.split(", ")]).collect()] for df, schema in zip(own, (DETONATIONS, TRACKS), strict=True))
    assert sorted(map(tuple, N.QUERIES["track_match"](spark, FOLDER).collect())) == plain_match(events, tracks)


def kills(seed):
    rng = random.Random(seed)
    who = lambda: rng.choice(["a", "b", "c", "x", "y", None])
    side = {"a": "CT", "b": "CT", "c": "CT", "x": "T", "y": "T", None: None}
    rows = [(rng.randrange(4), rng.randrange(0, 20), p, side[p], q, side[q], who()) for _ in range(60) for p, q in [(who(), who())]]
    return rows, [(r, t) for r in range(5) for t in rng.sample(range(-2, 25), 8)] + [(0, 3), (0, 3)]


def test_sums_and_sets_along_time(spark):
    rows, at = kills(2)
    frame = spark.createDataFrame(rows, "round_id long, round_sec int, attacker string, attacker_side string, victim string, victim_side string, assister string")
    moments = spark.createDataFrame(at, "round_id long, t int")
    tallies, dead = {}, {}
    for r, t in set(at):
        for k in (k for k in rows if k[0] == r and k[1] <= t):
            dead.setdefault((r, t), set()).update({k[4]} - {None})
            for who, place, points in ((k[4], 1, 1), (k[2], 0, 0 if k[2] == k[4] else -1 if k[3] == k[5] else 1), (k[6], 2, 1)):
                if who is not None:
                    tallies.setdefault((r, t, who), [0, 0, 0])[place] += points
    got = playback.live_tallies(frame, moments)
    assert {(r.round_id, r.t, r.player): [r.kills, r.deaths, r.assists] for r in got.collect()} == tallies
    assert {(r.round_id, r.t): r.dead for r in playback.dead_at(frame, moments).collect()} == {k: sorted(v) for k, v in dead.items()}
    for df in (got, playback.dead_at(frame, moments)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "<=" not in plan.split("Join")[-1] if "Join" in plan else True


def some_blobs(seed):
    rng = np.random.default_rng(seed)
    out = [None, b"", b"\x03", b"\x02", bytes(1 + 180), b"\x03" + bytes(179), b"x" * 16]
    for _ in range(60):
        out += [b"\x03" + rng.bytes(180), rng.bytes(10 * B.V1.itemsize), rng.bytes(10 * B.V2.itemsize), rng.bytes(int(rng.integers(0, 300)))]
    clean = np.zeros(10, B.V2)
    for c in B.V2.names:
        clean[c] = rng.integers(0, 200, 10)
    return [*out, clean.tobytes(), b"\x03" + np.zeros(10, B.V3).tobytes()]


def same(a, b):
    return (a is None and b is None) or a == b or (a != a and b != b)


def test_columns_of_blobs_equal_the_row_decoder():
    own = some_blobs(1)
    for column in (pa.array(own, pa.binary()), pa.array([b"skipped", *own], pa.binary()).slice(1), pa.array(own[:0], pa.binary()), pa.array([None], pa.binary())):
        rows = column.to_pylist()
        with np.errstate(all="ignore"):
            got = B.unpack_snapshots(column).to_pylist()
            want = [None if (x := B.unpack_snapshot(b)) is None else [dict(zip(B.FIELDS, r, strict=True)) for r in x] for b in rows]
        assert [None if g is None else len(g) for g in got] == [None if w is None else len(w) for w in want]
        assert all(same(p[c], q[c]) for g, w in zip(got, want, strict=True) if w for p, q in zip(g, w, strict=True) for c in B.FIELDS)


def test_columns_of_paths_equal_the_row_decoder():
    rng = np.random.default_rng(3)
    floats = [rng.uniform(-5000, 5000, (int(n), 4)).astype("<f4").tobytes() for n in rng.integers(1, 9, 40)]
    shorts = [b"\x02" + rng.bytes(8 * int(n)) for n in rng.integers(0, 9, 40)]
    ties = np.array([[0.25, 0.35, -0.45, 2.5]], "<f4").tobytes()
    own = [x for pair in zip(floats, shorts, strict=True) for x in pair] + [None, b"", b"\x02", b"\x02abc", b"odd", ties]
    got = B.unpack_paths(pa.array(own, pa.binary())).to_pylist()
    want = [None if (x := B.unpack_path(b)) is None else [dict(zip("txyz", r, strict=True)) for r in x] for b in own]
    assert [w and len(w) for w in want] == [g and len(g) for g in got]
    assert all(p == q for g, w in zip(got, want, strict=True) if w for p, q in zip(g, w, strict=True))


def test_blobs_in_spark(spark):
    own = some_blobs(5)
    df = spark.createDataFrame(pd.DataFrame({"k": range(len(own)), "b": own}), "k long, b binary")
    got = {r.k: r.n for r in df.select("k", F.size(B.players_of(F.col("b"))).alias("n")).collect()}
    with np.errstate(all="ignore"):
        assert got == {k: None if (x := B.unpack_snapshot(b)) is None else len(x) for k, b in enumerate(own)}
    assert "ArrowEvalPython" in df.select(B.path_of(F.col("b")))._jdf.queryExecution().executedPlan().toString()


def test_only_heads_of_files_are_read(spark, tmp_path):
    large = tmp_path / "sub folder" / "large.dem"
    large.parent.mkdir()
    with open(large, "wb") as f:
        f.write(b"head" * 1000)
        f.truncate(3 << 30)  # sparse: three GB that nobody should read
    (tmp_path / "small.dem").write_bytes(b"abc")
    (tmp_path / "other.txt").write_bytes(b"abc")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.content_keys(spark, str(tmp_path)).collect()}
    head = b"head" * 1000 + bytes(P.FINGERPRINT_BYTES - 4000)
    assert got["large.dem"].content_key == f"{hashlib.sha1(head).hexdigest()}:{3 << 30}" and got["large.dem"].bytes_read == P.FINGERPRINT_BYTES
    assert got["small.dem"].content_key == f"{hashlib.sha1(b'abc').hexdigest()}:3" and got["small.dem"].bytes_read == 3
    assert len(got) == 2
