"""Navigation meshes: from walkable areas to nodes, distances and a raster.

Merging, layering and dilation depend on order, so a map at a time goes through Python; maps run in parallel. A map has
a few thousand areas and at most MAX_NODES nodes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacgrid import params as P


def default_k(n_areas: int) -> int:
    return max(60, min(180, n_areas // 20))


def symmetric(edges: DataFrame) -> DataFrame:
    """edges (map_name, a, b) in both directions, once each, without loops."""
    swapped = edges.select("map_name", F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("map_name", "a", "b").union(swapped).where("a <> b").distinct()


@dataclass
class Patch:
    """Areas that have grown together: weight and centre in the plane and in height, and links to other patches by strength."""

    first: int
    areas: list[int]
    weight: float
    place: np.ndarray
    links: dict[int, int] = field(default_factory=dict)

    def pull(self, other: Patch) -> tuple[float, float, int]:
        """How much another patch attracts this one: link strength for its distance in the plane, then the smaller, then the earlier."""
        away = float(np.hypot(*(self.place - other.place)[:2]))
        return self.links[other.first] / (1 + away / 100), -other.weight, -other.first

    def take(self, other: Patch, patches: dict[int, Patch]) -> None:
        """Takes another patch in, with its links."""
        both = self.weight + other.weight
        self.place = (self.place * self.weight + other.place * other.weight) / both
        self.weight, self.areas = both, self.areas + other.areas
        for end, strength in other.links.items():
            third = patches[end]
            third.links.pop(other.first)
            if third is not self:
                self.links[end] = third.links[self.first] = self.links.get(end, 0) + strength


def _merge(areas: pd.DataFrame, edges: pd.DataFrame, k: int | None) -> pd.DataFrame:
    """The smallest patch joins the neighbour that attracts it most, until k are left; patches without neighbours stand aside."""
    rows = areas.sort_values("area_id")
    k = k or default_k(len(rows))
    if k > P.MAX_NODES:
        raise ValueError(f"at most {P.MAX_NODES} nodes")
    patches = {int(r.area_id): Patch(int(r.area_id), [int(r.area_id)], max(float(r.size), 1.0), np.array([r.x, r.y, r.z], float)) for r in rows.itertuples()}
    for a, b in zip(edges.a.tolist(), edges.b.tolist(), strict=True):
        if a in patches and b in patches:
            patches[a].links[b] = patches[a].links.get(b, 0) + 1
    queue = [(p.weight, first) for first, p in patches.items()]
    heapq.heapify(queue)
    while len(patches) > k and queue:
        weight, first = heapq.heappop(queue)
        small = patches.get(first)
        if small is None or small.weight != weight or not small.links:
            continue  # outdated, or nobody to join
        chosen = max((patches[end] for end in small.links), key=small.pull)
        early, late = sorted((small, chosen), key=lambda p: p.first)
        early.take(late, patches)
        del patches[late.first]
        heapq.heappush(queue, (early.weight, early.first))
    # Nodes are numbered from the top left: rows of 256 units, then columns.
    order = sorted(patches.values(), key=lambda p: (-round(p.place[1] / 256), round(p.place[0] / 256), p.first))
    return pd.DataFrame([(areas.map_name.iloc[0], a, n) for n, p in enumerate(order) for a in p.areas], columns=["map_name", "area_id", "node"])


def cluster_areas(areas: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """areas (map_name, area_id, size, x, y, z), edges (map_name, a, b) -> (map_name, area_id, node), nodes numbered from 0."""

    def solve(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        return _merge(a, e, k) if len(a) else pd.DataFrame(columns=["map_name", "area_id", "node"])

    return areas.groupBy("map_name").cogroup(symmetric(edges).groupBy("map_name")).applyInPandas(solve, "map_name string, area_id long, node int")


def node_centres(areas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Area-weighted centres of the nodes."""
    w = F.greatest("size", F.lit(1.0))
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    return areas.join(nodes, ["map_name", "area_id"]).groupBy("map_name", "node").agg(mean("x"), mean("y"), mean("z"))


def node_edges(edges: DataFrame, nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """(map_name, na, nb, d): nodes with linked areas, and how far their centres are apart."""
    at = lambda side, name: nodes.select("map_name", F.col("area_id").alias(side), F.col("node").alias(name))
    pairs = symmetric(edges).join(at("a", "na"), ["map_name", "a"]).join(at("b", "nb"), ["map_name", "b"]).where("na <> nb").select("map_name", "na", "nb").distinct()
    place = lambda node, p: centres.select("map_name", F.col("node").alias(node), *(F.col(c).alias(p + c) for c in "xyz"))
    apart = F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz"), F.lit(0.0)))
    return pairs.join(place("na", "p"), ["map_name", "na"]).join(place("nb", "q"), ["map_name", "nb"]).select("map_name", "na", "nb", apart.alias("d"))


def geodesics(edges: DataFrame, cap: float = P.GEODESIC_CAP) -> DataFrame:
    """edges (map_name, na, nb, d) -> (map_name, na, nb, d) of all pairs of nodes, no more than cap. One matrix a map."""

    def solve(e: pd.DataFrame) -> pd.DataFrame:
        n = int(max(e.na.max(), e.nb.max())) + 1
        if n > P.MAX_NODES:
            raise ValueError(f"at most {P.MAX_NODES} nodes")
        dist = np.full((n, n), np.inf)
        np.fill_diagonal(dist, 0)
        for a, b, d in zip(e.na, e.nb, e.d, strict=True):
            dist[a, b] = dist[b, a] = min(dist[a, b], d)
        for via in range(n):
            dist = np.minimum(dist, dist[:, via : via + 1] + dist[via])
        a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        return pd.DataFrame({"map_name": e.map_name.iloc[0], "na": a.ravel().astype(np.int32), "nb": b.ravel().astype(np.int32), "d": np.minimum(dist, cap).ravel()})

    return edges.groupBy("map_name").applyInPandas(solve, "map_name string, na int, nb int, d double")


def quads(areas: DataFrame) -> DataFrame:
    """areas with corners resampled to four: the first, the last, and two at equal steps between; four stay as they are."""
    last = F.size("corners") - 1
    return areas.withColumn("corners", F.array(*(F.get("corners", F.bround(last * k / 3.0).cast("int")) for k in range(4))))


RASTER = "map_name string, ix int, iy int, layer int, node int, z double, x0 double, y0 double, width int, height int"
RASTER_COLUMNS = [c.split()[0] for c in RASTER.split(", ")]
#: Cells of areas' boxes that are looked at together (or those of one area, if they are more).
DRAWN_AT_ONCE = 1 << 20


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    """A column that has no null."""
    if table.column(column).null_count:
        raise ValueError(f"null {column}")
    return table.column(column).to_numpy()


def _covered(part: np.ndarray, xs: np.ndarray, ys: np.ndarray, first: list[np.ndarray], n: list[np.ndarray], cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(area, ix, iy): the cells of these areas' boxes, n from first on, whose centres their quads cover."""
    boxed = (n[0] * n[1])[part]
    area = np.repeat(part, boxed)
    k = np.arange(len(area)) - np.repeat(np.cumsum(boxed) - boxed, boxed)
    ix, iy = first[0][area] + k // n[1][area], first[1][area] + k % n[1][area]
    px, py, hit = (ix + 0.5) * cell, (iy + 0.5) * cell, np.zeros(len(area), bool)
    for i in range(xs.shape[1]):
        xi, yi, xj, yj = xs[area, i], ys[area, i], xs[area, i - 1], ys[area, i - 1]
        over = (yi > py) != (yj > py)
        hit[over] ^= px[over] < (xj - xi)[over] * (py - yi)[over] / (yj - yi)[over] + xi[over]
    return area[hit], ix[hit], iy[hit]


def _draw(areas: pa.Table, cell: int) -> pa.Table:
    """The raster of one map; all its areas are drawn at once."""
    own = areas.take(pa.array(np.argsort(areas.column("area_id").to_numpy(), kind="stable")))
    node, z = _numbers(own, "node"), own.column("z").to_numpy()
    low = [float(np.nanmin(own.column(f"low_{c}").to_numpy())) - P.RASTER_MARGIN * cell for c in "xy"]
    high = [float(np.nanmax(own.column(f"high_{c}").to_numpy())) + P.RASTER_MARGIN * cell for c in "xy"]
    width, height = (math.ceil((h - o) / cell) for h, o in zip(high, low, strict=True))
    xs, ys = (own.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) - o for c, o in zip(("xs", "ys"), low, strict=True))
    if not (np.isfinite(xs).all() and np.isfinite(ys).all()):
        raise ValueError("corners without a place")
    first = [np.maximum(0, np.floor(v.min(1) / cell).astype(np.int64)) for v in (xs, ys)]
    n = [np.maximum(0, np.minimum(size - 1, np.floor(v.max(1) / cell).astype(np.int64)) - f + 1) for v, f, size in zip((xs, ys), first, (width, height), strict=True)]
    block = np.cumsum(n[0] * n[1]) // DRAWN_AT_ONCE
    parts = np.split(np.arange(len(own)), np.flatnonzero(np.diff(block)) + 1)
    area, ix, iy = (np.concatenate(c) for c in zip(*(_covered(part, xs, ys, first, n, cell) for part in parts), strict=True))
    tiny = np.flatnonzero(np.bincount(area, minlength=len(own)) == 0)
    middle = lambda v: np.array([int(sum(p) / len(p) / cell) for p in v[tiny].tolist()], np.int64)
    area, ix, iy = np.concatenate([area, tiny]), np.concatenate([ix, middle(xs)]), np.concatenate([iy, middle(ys)])
    # The areas of a cell in order; the first of all cells take their layers at once, then the second ones, and so on.
    order = np.lexsort([area, ix * height + iy])
    area, at = area[order], (ix * height + iy)[order]
    cells, start, areas_of = np.unique(at, return_index=True, return_counts=True)
    count, nodes, heights = np.zeros(len(cells), np.int64), np.zeros((len(cells), P.RASTER_LAYERS), np.int32), np.zeros((len(cells), P.RASTER_LAYERS))
    slots = np.arange(P.RASTER_LAYERS)
    left = np.arange(len(cells))
    for turn in range(int(areas_of.max())):
        left = left[(areas_of[left] > turn) & (count[left] < P.RASTER_LAYERS)]
        if not len(left):
            break
        a = area[start[left] + turn]
        free = ((slots >= count[left, None]) | (np.abs(heights[left] - z[a, None]) >= P.RASTER_LAYER_GAP)).all(1)
        to, a = left[free], a[free]
        nodes[to, count[to]], heights[to, count[to]] = node[a], z[a]
        count[to] += 1
    which, layer = np.nonzero(slots < count[:, None])
    same = lambda value, kind: pa.repeat(pa.scalar(value, kind), len(which))
    ints = lambda v: pa.array(v.astype(np.int32))
    columns = [ints(cells[which] // height), ints(cells[which] % height), ints(layer), ints(nodes[which, layer]), pa.array(heights[which, layer], from_pandas=True)]
    constant = [same(low[0], pa.float64()), same(low[1], pa.float64()), same(width, pa.int32()), same(height, pa.int32())]
    return pa.table([same(areas.column("map_name")[0].as_py(), pa.string()), *columns, *constant], RASTER_COLUMNS)


def _fill(raster: pa.Table, rounds: int) -> pa.Table:
    """The raster of one map, dilated."""
    width, height = raster.column("width")[0].as_py(), raster.column("height")[0].as_py()
    layer, at = _numbers(raster, "layer"), _numbers(raster, "ix").astype(np.int64) * height + _numbers(raster, "iy")
    own = np.lexsort([layer, at])
    cells, first, layers = np.unique(at[own], return_index=True, return_counts=True)
    giver = np.full((width, height), -1)  # whose layers a cell has
    giver.reshape(-1)[cells] = np.arange(len(cells))
    for _ in range(rounds):
        before = giver.copy()
        for dx, dy in P.RASTER_SIDES:
            to = giver[max(dx, 0) : width + min(dx, 0), max(dy, 0) : height + min(dy, 0)]
            source = giver[max(-dx, 0) : width + min(-dx, 0), max(-dy, 0) : height + min(-dy, 0)]
            new = (to < 0) & (source >= 0)
            to[new] = source[new]
        if (giver == before).all():
            break
    x, y = np.nonzero(giver >= 0)
    source = giver[x, y]
    n = layers[source]
    rows = own[np.repeat(first[source] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    out = raster.select(RASTER_COLUMNS).take(pa.array(rows))
    for i, v in ((1, x), (2, y)):
        out = out.set_column(i, RASTER_COLUMNS[i], pa.array(np.repeat(v, n).astype(np.int32)))
    return out


def _each_map(rows: DataFrame, solve: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """solve, a map at a time. Maps are few bytes and much work, so their number of tasks is given, not told by their size.

    It isn't the usual number, since Spark leaves a repartition out that equals one below it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(2 * n, "map_name").groupBy("map_name").applyInArrow(solve, RASTER)


def rasterise(areas: DataFrame, cell: int = P.RASTER_CELL, rounds: int = 0) -> DataFrame:
    """areas (map_name, area_id, node, z, corners array<struct<x,y>>) -> RASTER: a row for each layer of a cell that has any.

    x0, y0: the raster's origin, RASTER_MARGIN cells beyond the least corner; cells are counted from there. Of each area
    its quad counts: a cell belongs to the areas that its centre lies in, and a tiny area marks the cell of its centre.
    In order of areas, each takes a layer of the cell unless one less than RASTER_LAYER_GAP away in height is there;
    RASTER_LAYERS at most. rounds: the raster is dilated so many times at most before it leaves the task, as dilate does.
    """
    corner = lambda c, f: f(F.transform("corners", lambda p: p[c]))
    place = lambda v: v.cast("double")
    bounds = [place(corner(c, f)).alias(f"{name}_{c}") for c in "xy" for name, f in (("low", F.array_min), ("high", F.array_max))]
    flat = quads(areas.select("map_name", "area_id", "node", F.col("z").cast("double").alias("z"), "corners", *bounds))
    flat = flat.withColumn("xs", F.transform("corners", lambda p: place(p["x"]))).withColumn("ys", F.transform("corners", lambda p: place(p["y"]))).drop("corners")
    return _each_map(flat, lambda a: _fill(_draw(a, cell), rounds) if rounds else _draw(a, cell))


def dilate(raster: DataFrame, rounds: int = P.DILATION_ROUNDS) -> DataFrame:
    """Fills empty cells within the raster's bounds from their neighbours, all layers at once, rounds times at most.

    In a round cells give to one side after another, in the order of RASTER_SIDES; later sides see what earlier ones filled.
    """
    return _each_map(raster.select(*(F.col(c).cast(kind).alias(c) for c, kind in (f.split() for f in RASTER.split(", ")))), lambda r: _fill(r, rounds))


def _at_cells(points: DataFrame, raster: DataFrame, cell: int, of_cell: dict[str, Column] | None = None) -> DataFrame:
    """points with _layers, the layers of their cell, or what of_cell makes of these (null off the raster): one row of the raster for each cell, so that nothing is grouped by point.

    Cells are counted from the origin and cut towards zero, so a point less than a cell before the origin is in the first one.
    """
    cells = raster.groupBy("map_name", F.col("ix").alias("_ix"), F.col("iy").alias("_iy")).agg(F.array_sort(F.collect_list(F.struct("layer", "node", "z"))).alias("_layers"))
    if of_cell is not None:
        cells = cells.select("map_name", "_ix", "_iy", *(c.alias(name) for name, c in of_cell.items()))
    origin = raster.groupBy("map_name").agg(F.first("x0").alias("_x0"), F.first("y0").alias("_y0"))
    at = lambda c, o: ((F.col(c) - F.col(o)) / cell).cast("int")
    placed = points.join(origin, "map_name", "left").withColumn("_ix", at("x", "_x0")).withColumn("_iy", at("y", "_y0"))
    return placed.join(cells, ["map_name", "_ix", "_iy"], "left")


def resolve(points: DataFrame, raster: DataFrame, lower_max: float | None = None, cell: int = P.RASTER_CELL) -> DataFrame:
    """points (map_name, x, y, level) of a sketch and node: the lowest layer of the cell, of the wanted level if there is one.

    A layer is the lower one below lower_max (None: the map has one level); level is lower, upper or null.
    """
    other = lambda level: lambda l: F.lit(0) if lower_max is None or level is None else F.when((l["z"] < lower_max) == F.lit(level == "lower"), 0).otherwise(1)  # noqa: E731, E741
    best = lambda level: F.array_min(F.transform("_layers", lambda l: F.struct(other(level)(l).alias("other"), l["layer"].alias("layer"), l["node"].alias("node"))))["node"]  # noqa: E731, E741
    placed = _at_cells(points, raster, cell, {"_any": best(None), "_lower": best("lower"), "_upper": best("upper")})
    node = F.when(F.col("level").isNull(), F.col("_any")).when(F.col("level") == "lower", F.col("_lower")).otherwise(F.col("_upper")) if lower_max is not None else F.col("_any")
    return placed.select(*points.columns, node.alias("node"))


def locate(points: DataFrame, raster: DataFrame, cell: int = P.RASTER_CELL) -> DataFrame:
    """points (map_name, x, y, z, ...) and node: of the cell's layers the one nearest in height, ties the lowest; null off the raster."""
    best = F.array_min(F.transform("_layers", lambda l: F.struct(F.abs(l["z"] - F.col("z")).alias("away"), l["layer"].alias("layer"), l["node"].alias("node"))))  # noqa: E741
    return _at_cells(points, raster, cell).select(*points.columns, best["node"].alias("node"))


def build_map(areas: DataFrame, edges: DataFrame, k: int | None = None) -> dict[str, DataFrame]:
    """All that is derived from the meshes of maps: nodes, centres, geo and a filled raster.

    areas: map_name, area_id, size, x, y, z, corners (a column node is left out); edges: map_name, a, b.
    """
    areas = areas.drop("node")
    nodes = cluster_areas(areas, edges, k)
    centres = node_centres(areas, nodes)
    raster = rasterise(areas.select("map_name", "area_id", "z", "corners").join(nodes, ["map_name", "area_id"]), rounds=P.DILATION_ROUNDS)
    return {"areas": nodes, "centres": centres, "geo": geodesics(node_edges(edges, nodes, centres)), "raster": raster}


def map_job(library, areas: DataFrame, edges: DataFrame, calibrations: dict, images: set[str], wanted: set[str] | None = None, k: int | None = None, kept: dict | None = None) -> tuple[dict[str, str], dict]:
    """Builds maps into a library: (what became of each map, calibrations of all maps built so far).

    wanted: a subset of maps (None: all); of the others nothing is touched, and what kept has of them stays. Only maps of a mode
    (P.MAP_PREFIXES) count. Maps without a calibration, without an image and with more nodes than there are numbers for are
    skipped and said so; the others are built together. Null values of calibrations are left out.
    """
    n_areas = {r["map_name"]: r["n"] for r in areas.groupBy("map_name").agg(F.count("*").alias("n")).collect()}
    told: dict[str, str] = {}
    for name in sorted(m for m in n_areas if (not wanted or m in wanted) and m.startswith(P.MAP_PREFIXES)):
        if name not in calibrations:
            told[name] = "skipped: no calibration"
        elif name not in images:
            told[name] = "skipped: no image"
        elif (k or default_k(n_areas[name])) > P.MAX_NODES:
            told[name] = f"failed: at most {P.MAX_NODES} nodes"
        else:
            told[name] = "ok"
    good = [m for m, what in told.items() if what == "ok"]
    if good:
        own = lambda df: df.where(F.col("map_name").isin(*good))
        library.write_map(build_map(own(areas), own(edges), k))
    return told, {**(kept or {}), **{m: {c: v for c, v in calibrations[m].items() if v is not None} for m in good}}
