"""Distances on the globe and groups of near points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.operators.components import components

#: Metres (fixed values): mean radius of the Earth, and the distance within which venues are one.
RADIUS, NEAR = 6_371_000.0, 200.0


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres (haversine, atan2 form); NULL if a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * RADIUS) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def _cells(p: DataFrame, side: float) -> DataFrame:
    """``p`` with the cell of space each point (y, x in degrees) lies in: cubes of ``side`` metres, so poles and the date line are places like others."""
    lat, lon = F.radians("y"), F.radians("x")
    axes = {"cx": F.cos(lat) * F.cos(lon), "cy": F.cos(lat) * F.sin(lon), "cz": F.sin(lat)}
    return p.withColumns({c: F.floor(v * RADIUS / side) for c, v in axes.items()})


def _points(points: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    p = points.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    return p.where("y is not null and x is not null and not isnan(y) and not isnan(x)").distinct()


def _near(p: DataFrame, metres: float, across: Column | None = None) -> DataFrame:
    """(a, b, metres) of the points (k, y, x) at most ``metres`` apart: each meets those of its own and the 26 cells around it."""
    cells = _cells(p, metres)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(n).alias("n")) for i in (-1, 0, 1) for j in (-1, 0, 1) for n in (-1, 0, 1)])
    left = cells.withColumn("d", F.explode(around)).select(*[F.col(c).alias(f"_{c}") for c in p.columns], (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), (F.col("cz") + F.col("d.n")).alias("cz"))
    met = left.join(cells, ["cx", "cy", "cz"]).where(F.col("_k") < F.col("k"))
    met = met if across is None else met.where(across)
    gap = distance_m(F.col("_y"), F.col("_x"), F.col("y"), F.col("x"))
    return met.select(F.col("_k").alias("a"), F.col("k").alias("b"), gap.alias("metres")).where(F.col("metres") <= metres)


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, metres: float = NEAR) -> DataFrame:
    """(a, b, metres) of points at most ``metres`` apart, through a grid of cells: no cross join.

    All pairs are the result, so it grows with the square of the points of a place; :func:`near_groups` does not.
    Points without coordinates meet none.
    """
    return _near(_points(points, key, lat, lon), metres).groupBy("a", "b").agg(F.min("metres").alias("metres"))


def near_groups(points: DataFrame, key: str, lat: str, lon: str, same: str | None = None, metres: float = NEAR) -> DataFrame:
    """(vertex, component): points near each other, directly or through others, or with the same ``same`` value.

    Points of one place, and the places of a cell so small that all of it is near, are joined to their first
    as a star; only places of different such cells are compared in pairs. Unlike a greedy pass in name
    order, one point that links two groups joins them.
    """
    p = _points(points, key, lat, lon)
    first = p.groupBy("y", "x").agg(F.min("k").alias("k"))
    stars = p.withColumnRenamed("k", "a").join(first.withColumnRenamed("k", "b"), ["y", "x"]).where("a <> b").select("a", "b")
    fine = _cells(first, metres * 0.999 / math.sqrt(3)).select("k", "y", "x", F.concat_ws(",", "cx", "cy", "cz").alias("cell"))
    heads = fine.groupBy("cell").agg(F.min("k").alias("b"))
    edges = stars.unionByName(fine.join(heads, "cell").where("k <> b").select(F.col("k").alias("a"), "b"))
    edges = edges.unionByName(_near(fine, metres, F.col("_cell") != F.col("cell")).select("a", "b"))
    if same:
        rows = points.select(F.col(key).alias("a"), F.col(same).alias("s")).where("s is not null").distinct()
        low = rows.groupBy("s").agg(F.min("a").alias("b"))
        edges = edges.unionByName(rows.join(low, "s").where("a <> b").select("a", "b"))
    return components(edges)
