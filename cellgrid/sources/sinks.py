"""Exports: CSV, GeoJSON features, OGC pages, the polygon cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.query import page


def write_csv(cells: DataFrame, path: str) -> None:
    """Six columns with a header."""
    cells.select("dggid", "tid", "attr_key", "value_text", "value_num", "value_json").write.option("header", True).mode("overwrite").csv(path)


def features(cells: DataFrame, centroid: Column) -> DataFrame:
    """One GeoJSON feature per cell object: a point at the cell's centre with the object as properties."""
    props = F.struct("dggid", "tid", "attr_key", "value_text", "value_num", "value_json")
    c = centroid
    point = F.struct(F.lit("Point").alias("type"), F.array(c["lon"], c["lat"]).alias("coordinates"))
    return cells.select("dggid", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties"))).alias("feature"))


def write_geojson_lines(cells: DataFrame, centroid: Column, path: str) -> None:
    """Features as newline-delimited GeoJSON."""
    features(cells, centroid).select("feature").write.mode("overwrite").text(path)


def items_page(cells: DataFrame, centroid: Column, box: tuple[float, float, float, float] | None = None, zones: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of features, by zone list and by the box that holds the centres."""
    if zones:
        cells = cells.where(F.col("dggid").isin(zones))
    if box:
        w, s, e, n = box
        cells = cells.where(centroid["lon"].between(w, e) & centroid["lat"].between(s, n))
    return features(page(cells, limit, offset), centroid)


def polygons(cells: DataFrame, ring: Column, level: Column) -> DataFrame:
    """Rows of the polygon cache: zone_id, refinement, wkt and ring."""
    wkt = F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["lon"], p["lat"])), ", "), F.lit("))"))
    return cells.select(F.col("dggid").alias("zone_id"), level.alias("refinement"), wkt.alias("wkt"), ring.alias("ring")).dropDuplicates(["zone_id"])


def cache_put(old: DataFrame, new: DataFrame) -> DataFrame:
    """The polygon cache with new rows in place of old ones of the same zone."""
    return old.join(new.select("zone_id"), "zone_id", "left_anti").unionByName(new.dropDuplicates(["zone_id"]))


def cache_count(cache: DataFrame) -> int:
    """How many polygons are cached."""
    return cache.count()


def cache_clear(cache: DataFrame) -> DataFrame:
    """An empty cache of the same form."""
    return cache.limit(0)


def cache_query(cache: DataFrame, sql: str) -> DataFrame:
    """The rows of one SELECT over the cache, which the SQL names {cache}."""
    words = sql.lower().split()
    if not words or words[0] not in ("select", "with") or ";" in sql:
        raise ValueError("only a single SELECT can be asked")
    return cache.sparkSession.sql(sql, cache=cache)


def cache_get(cache: DataFrame, ids: DataFrame) -> DataFrame:
    """Cached polygons of the given zones (zone_id)."""
    return cache.join(ids.select("zone_id"), "zone_id", "left_semi")
