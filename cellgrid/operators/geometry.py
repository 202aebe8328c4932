"""Shapes of cell sets: centres, boxes, hulls, lines of sight; `points` is (…, lon, lat)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mean_centre(points: DataFrame, by: list[str]) -> DataFrame:
    """The mean of the centres per group."""
    return points.groupBy(*by).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("cells"))


def bounding_box(points: DataFrame, by: list[str]) -> DataFrame:
    """West, south, east and north of the centres per group."""
    return points.groupBy(*by).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull in counter-clockwise order from the lowest left, without those on its edges."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq: Iterator[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for c in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return half(iter(p)) + half(reversed(p))


def convex_hull(points: DataFrame, group: str) -> DataFrame:
    """(group, corner, lon, lat): hulls of the parts of each group first, then the hull of those hulls.

    A part's hull is far smaller than the part, so no task gathers a group's points.
    """
    kind = dict(points.dtypes)[group]

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for g, x in f.groupby(group, dropna=False):
                held[g] = hull([*held.get(g, []), *zip(x.lon, x.lat, strict=True)])
        rows = [(g, k, *c) for g, v in held.items() for k, c in enumerate(v)]
        yield pd.DataFrame(rows, columns=[group, "corner", "lon", "lat"])

    schema = f"`{group}` {kind}, corner int, lon double, lat double"
    parts = points.select(group, F.lit(0).alias("corner"), "lon", "lat").mapInPandas(reduce, schema)
    return parts.groupBy(group).applyInPandas(lambda x: next(reduce(iter([x]))), schema)


def split_by(cells: DataFrame, column: str) -> dict[object, DataFrame]:
    """One lazy DataFrame per value of a column with few values (at most a thousand)."""
    values = [r[0] for r in cells.select(column).distinct().limit(1001).collect()]
    if len(values) > 1000:
        raise ValueError(f"{column} has too many values to split by")
    return {v: cells.where(F.col(column).eqNullSafe(F.lit(v))) for v in values}


def label_summary(cells: DataFrame) -> DataFrame:
    """Count and mean value of each text label."""
    return cells.groupBy("value_text").agg(F.count("*").alias("cells"), F.avg("value_num").alias("mean"))


def durations(spark: SparkSession, start: str = "1000-01-01", end: str = "3000-01-01", unit: str = "YEAR") -> DataFrame:
    """The lookup table of nested durations of one unit: (tid, unit, begins, ends), numbered from 0."""
    t = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 {unit})) AS begins")
    t = t.where(F.col("begins") < F.lit(end).cast("date")).select("begins", F.expr(f"CAST(begins + INTERVAL 1 {unit} AS DATE)").alias("ends"))
    return t.selectExpr(f"CAST(timestampdiff({unit}, DATE '{start}', begins) AS BIGINT) AS tid", f"'{unit}' AS unit", "begins", "ends")
