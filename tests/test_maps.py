"""Map building over many maps of a given table against plain programs, and the map job's rules."""

import math

import pytest

from tacgrid import fixture as X
from tacgrid import params as P
from tacgrid.operators import navmesh
from tacgrid.plans import queries as N
from tacgrid.sources import store
from test_engine import plain_dilation, plain_raster

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def by_map(frame, *columns):
    out = {}
    for r in frame.select("map_name", *columns).collect():
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out


def plain_clusters(areas, edges, k):
    """Looks at every cluster and every link in each step. areas: id -> (size, x, y, z); edges: pairs, once each."""
    groups = {a: [a] for a in areas}
    while len(groups) > k:
        weight = {g: sum(max(areas[a][0], 1.0) for a in m) for g, m in groups.items()}
        place = {g: [sum(areas[a][i] * max(areas[a][0], 1.0) for a in m) / weight[g] for i in (1, 2)] for g, m in groups.items()}
        of = {a: g for g, m in groups.items() for a in m}
        links = {}
        for a, b in edges:
            if of[a] != of[b]:
                for pair in ((of[a], of[b]), (of[b], of[a])):
                    links[pair] = links.get(pair, 0) + 1
        linked = [g for g in groups if any(pair[0] == g for pair in links)]
        if not linked:
            break
        small = min(linked, key=lambda g: (round(weight[g], 6), g))
        score = lambda g: (round(links[small, g] / (1 + math.dist(place[small], place[g]) / 100), 9), -weight[g], -g)  # noqa: B023, E731
        best = max((pair[1] for pair in links if pair[0] == small), key=score)
        keep, gone = min(small, best), max(small, best)
        groups[keep] = groups[keep] + groups.pop(gone)
    return sorted(sorted(m) for m in groups.values())


def test_clusters_of_many_maps(spark):
    areas, edges = X.meshes(spark, FOLDER)
    got = by_map(N.QUERIES["cluster_areas"](spark, FOLDER), "area_id", "node")
    own, links = by_map(areas, "area_id", "size", "x", "y", "z"), by_map(edges, "a", "b")
    assert len(got) >= 25 and {m: len(v) for m, v in got.items()} == {m: len(v) for m, v in own.items()}
    for m in sorted(got)[:8]:
        nodes = {}
        for area, node in got[m]:
            nodes.setdefault(node, []).append(area)
        info = {a: rest for a, *rest in own[m]}
        assert sorted(sorted(v) for v in nodes.values()) == plain_clusters(info, links.get(m, []), 30)
        centre = {n: [sum(info[a][i] * info[a][0] for a in v) / sum(info[a][0] for a in v) for i in (1, 2)] for n, v in nodes.items()}
        key = [(-round(centre[n][1] / 256), round(centre[n][0] / 256), min(nodes[n])) for n in range(len(nodes))]
        assert key == sorted(key)


def test_rasters_of_many_maps(spark):
    areas, _ = X.meshes(spark, SMALL)
    got = by_map(N.QUERIES["raster_dilate"](spark, SMALL), "ix", "iy", "layer", "node", "z", "x0", "y0", "width", "height")
    own = by_map(areas, "area_id", "node", "z", "corners")
    assert set(got) == set(own) and len(got) >= 20
    for m in sorted(got)[:6]:
        origin, w, h, cells = plain_raster([(a, n, z, [(c.x, c.y) for c in corners]) for a, n, z, corners in sorted(own[m])])
        filled = plain_dilation(cells, w, h, min(P.DILATION_ROUNDS, w + h))
        assert {(x, y): [] for x, y, *_ in got[m]}.keys() == filled.keys()
        assert sorted((x, y, k, n, z) for x, y, k, n, z, *_ in got[m]) == sorted((x, y, k, n, z) for (x, y), layers in filled.items() for k, (n, z) in enumerate(layers))
        assert {tuple(r[5:]) for r in got[m]} == {(*origin, w, h)}


def test_distances_of_many_maps(spark):
    got = by_map(N.QUERIES["geodesic_closure"](spark, SMALL), "na", "nb", "d")
    steps = by_map(X.mesh_steps(spark, SMALL), "na", "nb", "d")
    for m in sorted(steps)[:5]:
        n = max(max(a, b) for a, b, _ in steps[m]) + 1
        dist = [[0.0 if a == b else math.inf for b in range(n)] for a in range(n)]
        for _ in range(n):
            for a, b, d in steps[m]:
                for s in range(n):
                    dist[s][b] = min(dist[s][b], dist[s][a] + d)
                    dist[s][a] = min(dist[s][a], dist[s][b] + d)
        assert sorted(got[m]) == sorted((a, b, min(dist[a][b], P.GEODESIC_CAP)) for a in range(n) for b in range(n))


def test_map_job(spark, tmp_path):
    """A subset of maps is built, others stay; what lacks a calibration or an image is skipped."""
    areas, edges = X.meshes(spark, SMALL)
    names = sorted({r.map_name for r in areas.select("map_name").distinct().collect()})[:4]
    library = store.Library(spark, str(tmp_path / "library"))
    calibrations = {m: {"scale": 5.0, "lower_max": None} for m in (*names[:3], "cs_none")}
    told, kept = navmesh.map_job(library, areas, edges, calibrations, images=set(names[:2]), wanted=set(names), k=3)
    assert told == {names[0]: "ok", names[1]: "ok", names[2]: "skipped: no image", names[3]: "skipped: no calibration"}
    assert kept == {names[0]: {"scale": 5.0}, names[1]: {"scale": 5.0}}
    before = by_map(library.read("geo"), "na", "nb", "d")
    assert set(before) <= set(names[:2])
    told, kept = navmesh.map_job(library, areas, edges, {names[2]: {"scale": 9.0}}, images=set(names), wanted={names[2]}, k=2, kept=kept)
    assert told == {names[2]: "ok"} and set(kept) == set(names[:3]) and kept[names[0]] == {"scale": 5.0}
    after = by_map(library.read("areas"), "node")
    assert set(after) == set(names[:3]) and {m: v for m, v in by_map(library.read("geo"), "na", "nb", "d").items() if m in before} == before
    assert navmesh.map_job(library, areas, edges, calibrations, images=set(names), wanted={names[0]}, k=P.MAX_NODES + 1)[0] == {names[0]: f"failed: at most {P.MAX_NODES} nodes"}
    assert navmesh.map_job(library, areas.withColumn("map_name", areas["node"].cast("string")), edges, calibrations, images=set())[0] == {}
