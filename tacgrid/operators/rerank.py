"""Stage two: exact costs of the few snapshots that recall has left."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tacgrid import params as P
from tacgrid.functions.scalar import pair_cost
from tacgrid.operators.recall import Geodesics, Marker


def _constant(values) -> str:
    """Nested lists of numbers as SQL."""
    return f"array({', '.join(map(_constant, values))})" if isinstance(values, (list, tuple)) else repr(values)


def same_level(marker: Marker, at: Column, lower_max: float | None) -> Column | None:
    """Whether something lies on the marker's own floor; None: always, as the marker has no level or the map has one floor."""
    if marker.level is None or lower_max is None:
        return None
    return F.coalesce((at["z"] < lower_max) == F.lit(marker.level == "lower"), F.lit(False))


def any_size_cost(players: Column, markers: list[Marker], cost, pad: Column, strict_optimal: bool) -> Column:
    """assignment_cost of any number of players, by the least total for each set of markers, a player at a time."""
    k = len(markers)
    far = float("inf")
    own = F.transform(players, lambda p: F.array(*(cost(m, p) for m in markers)))
    start = F.array(*(F.lit(0.0 if s == 0 else far) for s in range(1 << k)))

    def add(least: Column, c: Column) -> Column:
        given = lambda s: [F.get(least, F.lit(s ^ 1 << i)) + F.get(c, F.lit(i)) for i in range(k) if s >> i & 1]
        return F.array(F.lit(0.0), *(F.least(F.get(least, F.lit(s)), *given(s)) for s in range(1, 1 << k)))

    m = F.least(F.size(players), F.lit(k))
    sets = lambda n: [s for s in range(1 << k) if s.bit_count() == n] if strict_optimal else [(1 << n) - 1]
    best = lambda least: F.get(F.array(*(F.array_min(F.array(*(F.get(least, F.lit(s)) for s in sets(n)))) for n in range(k + 1))), m)
    total = F.get(F.transform(F.array(F.aggregate(own, start, add)), best), F.lit(0))
    return (total + (F.lit(k) - m) * pad) / k


def assignment_cost(players: Column, markers: list[Marker], geo: Geodesics, strict_optimal: bool = False, lower_max: float | None = None) -> Column:
    """players: array of struct(node, x, y) of the living of one side, in order of slot. Mean over the markers of the best assignment.

    With fewer players than markers, the first as many markers are matched and the others charged the map's largest
    distance; with strict_optimal any of them are matched. Without players the cost is that distance. All choices for k
    markers and up to five players are constants, so a state is settled in its row; more players go one by one.
    lower_max: where the map's lower floor ends, None if it has one floor; else players need z too.
    """
    k = len(markers)
    ways: list[list[list[int]]] = []  # by m - 1: for each choice the player of each marker, -1 for none
    for m in range(1, 6):
        n = min(k, m)
        some = permutations(range(k), n) if strict_optimal and m < k else [tuple(range(n))]
        ways.append([[dict(zip(chosen, own, strict=True)).get(i, -1) for i in range(k)] for chosen in some for own in permutations(range(m), n)])
    pad = F.lit(geo.pad)
    exact = lambda mk, p: pair_cost(F.coalesce(geo.to(mk, p["node"]), pad), p["x"] - mk.x, p["y"] - mk.y, same_level(mk, p, lower_max))

    def best(alive: Column) -> Column:
        cost = lambda mk: F.transform(alive, lambda p: exact(mk, p))
        total = lambda c, way: reduce(lambda a, b: a + b, [F.when(F.get(way, F.lit(i)) < 0, pad).otherwise(F.get(F.get(c, F.lit(i)), F.get(way, F.lit(i)))) for i in range(k)])
        choices_of = F.get(F.expr(_constant(ways)), F.size(alive) - 1)
        found = F.transform(F.array(F.array(*map(cost, markers))), lambda c: F.array_min(F.transform(choices_of, lambda way: total(c, way))))
        return F.when(F.size(alive) == 0, pad).otherwise(F.get(found, F.lit(0)) / k)

    def of(alive: Column) -> Column:
        return F.when(F.size(alive) > 5, any_size_cost(alive, markers, exact, pad, strict_optimal)).otherwise(best(alive))

    return F.get(F.transform(F.array(players), of), F.lit(0))


def utility_cost(markers: list[Marker], geo: Geodesics, active: Column, radius: float = P.UTILITY_RADIUS, lower_max: float | None = None) -> Column:
    """Mean over the markers of the exact distance to the nearest active piece; null where one is farther than radius.

    lower_max: as for assignment_cost; pieces need z then.
    """
    exact = lambda m, u: pair_cost(F.coalesce(geo.to(m, u["node"]), F.lit(geo.pad)), u["x"] - m.x, u["y"] - m.y, same_level(m, u, lower_max))
    nearest = lambda m: F.array_min(F.transform(active, lambda u: exact(m, u)))
    each = [nearest(m) for m in markers]
    near = reduce(lambda a, b: a & b, [F.coalesce(c <= radius, F.lit(False)) for c in each])
    return F.when(near, reduce(lambda a, b: a + b, each) / len(each))
