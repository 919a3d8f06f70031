"""An index that prunes recall: how near and how far each side's tokens are from a few pivot nodes.

Distances are shortest paths, so for a marker q, a pivot v and any token t, d(q, t) is at least |d(v, q) - d(v, t)|. With the
nearest (lo) and farthest (hi) token of a side from v, the mean distance of a side's markers to their nearest tokens is at
least lo - mean d(v, q) and at least mean d(v, q) - hi. A state within the tolerance therefore has lo below and hi above
constants of the request: plain comparisons of columns, by which a scan leaves out row groups. Rows are stored in order
of coarse lo and hi, so that whole row groups fall away. What is left is decided by the cost itself.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacgrid import params as P
from tacgrid.operators.recall import Geodesics, Marker

#: Pivots of a map, steps of distance in which rows are ordered, rows of a row group.
PIVOTS, STEP, GROUP_ROWS = 4, 400.0, 2048
SLACK = 1e-6


def choose(geo: DataFrame, n: int = PIVOTS) -> list[int]:
    """Nodes far from each other: the one farthest from node 0, then always the one farthest from those there are; ties the lowest.

    geo: na, nb, d of one map, at most MAX_NODES squared rows.
    """
    rows = geo.select("na", "nb", "d").collect()
    size = max(r["na"] for r in rows) + 1
    if size > P.MAX_NODES:
        raise ValueError(f"at most {P.MAX_NODES} nodes")
    dist = np.zeros((size, size))
    for r in rows:
        dist[r["na"], r["nb"]] = r["d"]
    out = [int(dist[0].argmax())]
    while len(out) < min(n, size):
        away = dist[out].min(0)
        away[out] = -1
        out.append(int(away.argmax()))
    return out


def names(side: str, k: int) -> tuple[str, str]:
    return f"{side.lower()}_lo_{k}", f"{side.lower()}_hi_{k}"


def with_bounds(index: DataFrame, geo: Geodesics, pivots: list[int], tokens: dict[str, list[Column]]) -> DataFrame:
    """index with lo and hi of each side and pivot; 0 and the map's largest distance where nobody of a side is known, which prunes nothing."""
    columns = {}
    for k, node in enumerate(pivots):
        for side, own in tokens.items():
            each = [geo.to(Marker(side, node, 0.0, 0.0), t) for t in own]
            lo, hi = names(side, k)
            columns[lo], columns[hi] = F.coalesce(F.least(*each), F.lit(0.0)), F.coalesce(F.greatest(*each), F.lit(geo.pad))
    return index.withColumns(columns)


def write(index: DataFrame, path: str, pivots: list[int], sides: tuple[str, ...] = ("CT", "T"), group_rows: int = GROUP_ROWS) -> None:
    """index (with_bounds) as Parquet in order of its coarse bounds, those of the first pivots first."""
    coarse = [F.floor(F.col(c) / STEP).alias(f"_{c}") for k in range(len(pivots)) for side in sides for c in names(side, k)]
    order = [f"_{c}" for k in range(len(pivots)) for side in sides for c in names(side, k)]
    sorted_rows = index.select("*", *coarse).repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    sorted_rows.write.option("parquet.block.row.count.limit", group_rows).parquet(path)


def reachable(geo: Geodesics, markers: list[Marker], pivots: list[int], tolerance: float = P.DEFAULT_TOLERANCE) -> Column | None:
    """What must hold of the bounds for a recall cost within tolerance; None without markers of a side.

    The cost is the mean over the sides that have markers, and no side's is negative: a side's own is within the tolerance
    times the number of sides.
    """
    own = {side: [m for m in markers if m.kind == side] for side in ("CT", "T")}
    sides = {side: ms for side, ms in own.items() if ms}
    most = tolerance * len(sides) + SLACK
    parts = []
    for side, ms in sides.items():
        for k, node in enumerate(pivots):
            mean = sum(geo.rows[node][m.node] for m in ms) / len(ms)
            lo, hi = names(side, k)
            parts.append((F.col(lo) <= mean + most) & (F.col(hi) >= mean - most))
    return reduce(lambda a, b: a & b, parts) if parts else None


def row_groups(path: str, where: list[tuple[str, str, float]]) -> tuple[int, int]:
    """(row groups that comparisons (column, "<=" or ">=", value) leave, all) by the footers of the files of path; for reports."""
    import pyarrow.dataset as ds

    from tacgrid.sources.files import with_scheme

    test = None
    for column, sign, value in where:
        part = ds.field(column) <= value if sign == "<=" else ds.field(column) >= value
        test = part if test is None else test & part
    data = ds.dataset(with_scheme(path).removeprefix("file://"), format="parquet")
    every = [g for f in data.get_fragments() for g in f.split_by_row_group()]
    left = [g for f in data.get_fragments(filter=test) for g in f.split_by_row_group(filter=test)] if test is not None else every
    return len(left), len(every)


def comparisons(geo: Geodesics, markers: list[Marker], pivots: list[int], tolerance: float = P.DEFAULT_TOLERANCE) -> list[tuple[str, str, float]]:
    """reachable() as plain values, for row_groups."""
    sides = {side: ms for side in ("CT", "T") if (ms := [m for m in markers if m.kind == side])}
    most = tolerance * len(sides) + SLACK
    means = {(side, k): sum(geo.rows[node][m.node] for m in ms) / len(ms) for side, ms in sides.items() for k, node in enumerate(pivots)}
    return [x for (side, k), mean in means.items() for x in ((names(side, k)[0], "<=", mean + most), (names(side, k)[1], ">=", mean - most))]
