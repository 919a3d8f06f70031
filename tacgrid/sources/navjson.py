"""Navigation meshes as JSON, and calibrations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AREA = "map_name string, area_id long, corners array<struct<x:double,y:double,z:double>>, connections array<long>"


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object for each area -> areas with size and centre; polygons under three corners are left out.

    The size is the shoelace area of the corners, 1 at least.
    """
    raw = spark.read.schema(AREA).json(path).where(F.size("corners") >= 3)
    n = F.size("corners")
    cross = F.transform("corners", lambda c, i: c["x"] * F.get("corners", (i + 1) % n)["y"] - F.get("corners", (i + 1) % n)["x"] * c["y"])
    mean = lambda k: (F.aggregate(F.transform("corners", lambda c: c[k]), F.lit(0.0), lambda a, x: a + x) / n).alias(k)
    size = F.greatest(F.lit(1.0), F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2)
    return raw.select("map_name", "area_id", "corners", "connections", size.alias("size"), mean("x"), mean("y"), mean("z"))


def area_edges(areas: DataFrame) -> DataFrame:
    """(map_name, a, b) in both directions; links to areas that aren't there are left out."""
    from tacgrid.operators.navmesh import symmetric

    each = areas.select("map_name", F.col("area_id").alias("a"), F.explode("connections").alias("b"))
    there = areas.select("map_name", F.col("area_id").alias("b"))
    return symmetric(each.join(there, ["map_name", "b"], "left_semi").select("map_name", "a", "b"))


def calibrations(bundled: dict, *overrides: str) -> dict:
    """bundled values by map, overridden by later JSON texts; texts that aren't JSON objects are skipped."""
    out = {k: dict(v) for k, v in bundled.items()}
    for text in overrides:
        try:
            more = json.loads(text)
        except ValueError:
            continue
        for name, values in more.items() if isinstance(more, dict) else ():
            if isinstance(values, dict):
                out[name] = {**out.get(name, {}), **values}
    return out
