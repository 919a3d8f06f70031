"""Stage one: cheap costs of every snapshot from node tokens."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacgrid import params as P


@dataclass(frozen=True)
class Marker:
    """kind: CT, T, smoke or molly. level: None, or the layer it is drawn on."""

    kind: str
    node: int
    x: float
    y: float
    level: str | None = None


@dataclass(frozen=True)
class Geodesics:
    """Rows of a map's distance matrix for the nodes of the markers: as many as there are markers. pad: the map's largest."""

    rows: dict[int, list[float]]
    pad: float

    @classmethod
    def read(cls, geo: DataFrame, nodes: set[int]) -> Geodesics:
        """geo: na, nb, d of one map, at most MAX_NODES squared rows."""
        if not nodes:
            return cls({}, 0.0)
        most = geo.agg(F.max("d").alias("pad"), F.max("nb").alias("nb")).first()
        pad = float(most["pad"])
        rows = {n: [pad] * (most["nb"] + 1) for n in nodes}
        for r in geo.where(F.col("na").isin(*nodes)).collect():
            rows[r["na"]][r["nb"]] = float(r["d"])
        return cls(rows, pad)

    def to(self, marker: Marker, node: Column) -> Column:
        """Distance from the marker; null for no node. The row is one constant, parsed as a whole."""
        return F.get(F.expr(f"array({', '.join(f'{d!r}D' for d in self.rows[marker.node])})"), node)


def chamfer(geo: Geodesics, markers: list[Marker], tokens: list[Column]) -> Column:
    """Mean over the markers of the distance to the nearest token; pads cost the map's largest distance."""
    each = [F.least(F.lit(geo.pad), F.lit(geo.pad), *(geo.to(m, t) for t in tokens)) for m in markers]
    return reduce(lambda a, b: a + b, each) / len(each)


def recall_cost(geo: Geodesics, markers: list[Marker], tokens: dict[str, list[Column]]) -> Column:
    """Mean over the sides that have markers; 0 without any."""
    sides = [chamfer(geo, own, tokens[side]) for side in ("CT", "T") if (own := [m for m in markers if m.kind == side])]
    return reduce(lambda a, b: a + b, sides) / len(sides) if sides else F.lit(0.0)


def utility_distance(geo: Geodesics, markers: list[Marker], active: dict[str, str]) -> Column | None:
    """Largest over the utility markers of the distance to the nearest active node (null: none is active).

    active: column of active nodes (array<struct<node, x, y>>) by kind.
    """
    own = [m for m in markers if m.kind in active]
    if not own:
        return None
    nearest = lambda m: F.array_min(F.transform(active[m.kind], lambda u: geo.to(m, u["node"])))
    each = [nearest(m) for m in own]
    none = reduce(lambda a, b: a | b, [c.isNull() for c in each])
    return F.when(~none, F.greatest(*each) if len(each) > 1 else each[0])


def recall(index: DataFrame, cost: Column, tolerance: float = P.DEFAULT_TOLERANCE) -> DataFrame:
    return index.withColumn("cost", cost).where(F.col("cost") <= tolerance)


def cheapest(found: DataFrame, cap: int = P.RECALL_CAP) -> DataFrame:
    """The cap cheapest, ties by state_id."""
    return found.orderBy("cost", "state_id").limit(cap)
