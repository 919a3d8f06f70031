"""A search: filters, recall, re-rank, moments, ranking, and the statistics of what was found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacgrid import params as P
from tacgrid.operators import pivots
from tacgrid.operators.filters import Filters, filter_snapshots
from tacgrid.operators.moments import moments, ranked
from tacgrid.operators.recall import Geodesics, Marker, cheapest, recall, recall_cost, utility_distance
from tacgrid.operators.rerank import assignment_cost, utility_cost
from tacgrid.sources.scratch import shared_folder

LISTS = {"smoke": "smokes", "molly": "mollies"}


@dataclass(frozen=True)
class Request:
    markers: tuple[Marker, ...] = ()
    filters: Filters = field(default_factory=Filters)
    tolerance: float = P.DEFAULT_TOLERANCE
    limit: int = P.DEFAULT_LIMIT
    cap: int = P.RECALL_CAP


@dataclass(frozen=True)
class Library:
    """index: snapshots with their rounds' columns and tokens, and lists of active utility.

    players: gives (state_id, players), an array of struct(slot, side, alive, node, x, y), for a few state_ids; the
    bulk of the snapshots is read for hits alone. lower_max: where the map's lower floor ends; players and active
    utility have z then. pivots: those whose bounds the index has as columns; recall then prunes by them.
    """

    index: DataFrame
    players: Callable[[DataFrame], DataFrame]
    geo: DataFrame
    tokens: dict
    lower_max: float | None = None
    pivots: tuple[int, ...] = ()


def population(lib: Library, request: Request) -> tuple[DataFrame, Geodesics]:
    """Recalled snapshots with cost and node_cost, before the cap."""
    geo = Geodesics.read(lib.geo, {m.node for m in request.markers} | set(lib.pivots if request.markers else ()))
    masked = filter_snapshots(lib.index, request.filters)
    near = pivots.reachable(geo, list(request.markers), list(lib.pivots), request.tolerance) if lib.pivots else None
    masked = masked if near is None else masked.where(near)
    away = utility_distance(geo, list(request.markers), LISTS)
    if away is not None:
        masked = masked.withColumn("util_cost", away).where(F.col("util_cost") <= P.UTILITY_GATE)
    found = recall(masked, recall_cost(geo, list(request.markers), lib.tokens), request.tolerance)
    return found.withColumn("node_cost", F.greatest("cost", "util_cost") if away is not None else F.col("cost")), geo


def _living(side: str):
    return F.filter("_people", lambda p: p["alive"] & (p["side"] == side))


def rerank(lib: Library, request: Request, hits: DataFrame, geo: Geodesics) -> DataFrame:
    """hits (request.cap rows at most) with score: the mean over the kinds of markers that are there."""
    kinds = []
    sides = {side: own for side in ("CT", "T") if (own := [m for m in request.markers if m.kind == side])}
    if sides:
        people = lib.players(hits.select("state_id")).select("state_id", F.array_sort("players").alias("_people"))
        hits = hits.join(people, "state_id", "left")
    for side, own in sides.items():
        hits = hits.withColumn(f"_{side}", F.coalesce(assignment_cost(_living(side), own, geo, lower_max=lib.lower_max), F.lit(geo.pad)))
        kinds.append(f"_{side}")
    for kind, column in LISTS.items():
        own = [m for m in request.markers if m.kind == kind]
        if own:
            hits = hits.withColumn(f"_{kind}", utility_cost(own, geo, F.col(column), lower_max=lib.lower_max)).where(F.col(f"_{kind}").isNotNull())
            kinds.append(f"_{kind}")
    score = reduce(lambda a, b: a + b, (F.col(k) for k in kinds)) / len(kinds) if kinds else F.lit(0.0)
    return hits.withColumn("score", score).drop(*kinds, "_people")


def scored(lib: Library, request: Request, population_: tuple[DataFrame, Geodesics] | None = None) -> DataFrame:
    """All moments of a request, unranked. population_: recalled snapshots, if they are there already.

    The hits of a sketch, request.cap rows, come to the driver and go out again with the plan: they are looked at for each
    kind of marker.
    """
    found, geo = population_ or population(lib, request)
    if not request.markers:
        hits = found.withColumn("score", F.lit(0.0))
    else:
        narrow = ["state_id", "round_id", "sec", "cost", "node_cost", *(LISTS[k] for k in LISTS if any(m.kind == k for m in request.markers))]
        best = cheapest(found.select(*narrow), request.cap)
        hits = rerank(lib, request, found.sparkSession.createDataFrame(best.collect(), best.schema), geo)
    return moments(hits.select("round_id", "sec", "state_id", "score", F.col("node_cost").alias("cost")))


def search(lib: Library, request: Request) -> DataFrame:
    """Ranked moments."""
    return ranked(scored(lib, request), request.limit)


@dataclass(frozen=True)
class Place:
    """Where a page ended, by what moments are ranked by; the next one begins after it."""

    exact: bool
    score: float
    seconds: int
    round_id: int
    t_start: int

    @classmethod
    def of(cls, row) -> Place:
        return cls(row["exact"], row["score"], row["t_end"] - row["t_start"], row["round_id"], row["t_start"])


class Kept:
    """The scored moments of one search, written once; pages are read from them, none asks for another recall."""

    def __init__(self, lib: Library, request: Request, name: str = "moments") -> None:
        self.spark = lib.index.sparkSession
        self.path = shared_folder(self.spark, name)
        scored(lib, request).write.parquet(self.path)
        self.moments = self.spark.read.parquet(self.path)

    def page(self, limit: int = P.DEFAULT_LIMIT, after: Place | None = None) -> DataFrame:
        """The next limit moments in rank order after a place, or the first ones. Places stay valid for as long as the search is kept."""
        rows = self.moments
        if after is not None:
            order = lambda exact, score, seconds, round_id, start: F.struct((~exact).alias("a"), score.alias("b"), (-seconds).alias("c"), round_id.alias("d"), start.alias("e"))
            own = order(F.col("exact"), F.col("score"), (F.col("t_end") - F.col("t_start")).cast("long"), F.col("round_id").cast("long"), F.col("t_start").cast("long"))
            last = order(F.lit(after.exact), F.lit(float(after.score)), F.lit(after.seconds).cast("long"), F.lit(after.round_id).cast("long"), F.lit(after.t_start).cast("long"))
            rows = rows.where(own > last)
        return ranked(rows, limit)

    def drop(self) -> None:
        """Deletes what was kept."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hydrate(found: DataFrame, lib: Library) -> DataFrame:
    """Moments with the round's columns and the players of their best state, coordinates to one decimal."""
    rounded = lambda p: F.struct(p["slot"].alias("slot"), p["side"].alias("side"), p["alive"].alias("alive"), p["node"].alias("node"), F.bround(p["x"], 1).alias("x"), F.bround(p["y"], 1).alias("y"))
    each = lib.players(found.select("state_id")).select("state_id", F.sort_array(F.transform("players", rounded)).alias("players"))
    about = lib.index.select("state_id", "recording_id", "map_id", "winner", "ct_team", "t_team", "planted").join(found, "state_id")
    return about.join(each, "state_id", "left").withColumn("score", F.bround("score", 1))
