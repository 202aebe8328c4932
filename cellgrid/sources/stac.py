"""Catalogues of scenes: items (id, collection, bbox, datetime, cloud_cover, assets as map of struct(href, type, roles))."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import iso_timestamp
from ..grid import HexLattice

ITEMS = "id string, collection string, bbox array<double>, datetime string, cloud_cover double, assets map<string,struct<href:string,type:string,roles:array<string>>>"


def search(items: DataFrame, collection: str | None = None, box: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None, max_cloud: float | None = None) -> DataFrame:
    """Items of a collection that meet a box, within dates, below a cloud cover."""
    x = items if collection is None else items.where(F.col("collection") == collection)
    if box:
        w, s, e, n = box
        x = x.where((F.col("bbox")[0] <= e) & (F.col("bbox")[2] >= w) & (F.col("bbox")[1] <= n) & (F.col("bbox")[3] >= s))
    at = iso_timestamp(F.col("datetime"))
    if start:
        x = x.where(at >= iso_timestamp(F.lit(start)))
    if end:
        x = x.where(at <= iso_timestamp(F.lit(end)))
    return x if max_cloud is None else x.where(F.col("cloud_cover") < max_cloud)


def normalise(items: DataFrame, band_names: dict[str, str] | None = None) -> DataFrame:
    """Items as scenes: bands (by the collection's names, else every asset that is a TIFF or has the role data), thumbnail, timestamp."""
    if band_names:
        names = F.create_map(*[F.lit(v) for kv in band_names.items() for v in kv])
        bands = F.transform_keys(F.map_filter("assets", lambda k, v: F.array_contains(F.map_keys(names), k)), lambda k, v: F.element_at(names, k))
    else:
        bands = F.map_filter("assets", lambda k, v: F.coalesce(v["type"].contains("image/tiff"), F.lit(False)) | F.coalesce(F.array_contains(v["roles"], "data"), F.lit(False)))
    thumb = F.coalesce(*[F.try_element_at("assets", F.lit(k))["href"] for k in ("thumbnail", "rendered_preview", "preview")])
    return items.select("id", "collection", "bbox", iso_timestamp(F.col("datetime")).alias("acquired"), "cloud_cover", F.transform_values(bands, lambda k, v: F.struct(v["href"].alias("href"), v["type"].alias("type"))).alias("bands"), thumb.alias("thumbnail"))


def all_bands(scenes: DataFrame) -> DataFrame:
    """Per collection its distinct bands, ordered by name."""
    return scenes.select("collection", F.explode(F.map_keys("bands")).alias("band")).groupBy("collection").agg(F.sort_array(F.collect_set("band")).alias("bands"))


def missing_bands(scenes: DataFrame, wanted: list[str]) -> DataFrame:
    """Scenes that lack wanted bands, with those."""
    return scenes.select("id", F.array_except(F.array(*map(F.lit, wanted)), F.map_keys("bands")).alias("missing")).where(F.size("missing") > 0)


def coverage(scenes: DataFrame, grid: HexLattice, level: int = 5, most: int = 500) -> DataFrame:
    """Scenes with the ids of the cells in their box, at most `most` in id order."""
    from .cover import cells_of, cover_boxes, expanded

    box = [F.col("bbox")[k].alias(c) for k, c in enumerate("wsen")]
    covers = cover_boxes(scenes.select("id", *box), grid, level)
    counted = covers.groupBy("id").agg(cells_of(level).alias("zone_count"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("dggid"))
    first = expanded(covers, grid, level).select("id", "dggid").distinct().withColumn("nth", nth).where(F.col("nth") <= most)
    return first.groupBy("id").agg(F.sort_array(F.collect_list("dggid")).alias("zones")).join(counted, "id")


def collections(scenes: DataFrame, covered: DataFrame) -> DataFrame:
    """Collections with scene count, coverage size and first and last time."""
    x = scenes.join(covered, "id", "left")
    return x.groupBy("collection").agg(F.count("*").alias("scenes"), F.sum(F.coalesce(F.size("zones"), F.lit(0))).alias("covered"), F.min("acquired").alias("first"), F.max("acquired").alias("last"))


def newest(scenes: DataFrame) -> DataFrame:
    """Scenes by time, newest first, those without time last."""
    return scenes.orderBy(F.col("acquired").desc_nulls_last(), "id")


def sample_scenes(scenes: DataFrame, headers: DataFrame, pixels: DataFrame, grid: HexLattice, level: int, bands: list[str], most: int = 100_000) -> DataFrame:
    """Cell objects (dggid, tid, attr_key, value_num) from the named bands of scenes: the pixel at each cell's centre.

    Cells are those in a scene's box, at most `most` a scene in id order; tid is the scene's time in seconds since 1970 (0
    without a time). A band's file is found by its href in `headers` (path, west, north, pixel_width, pixel_height, rows,
    cols, nodata, and crs for files that aren't in degrees) and in `pixels`: (path, row, col, value), or the packed blocks of
    GeoTIFF files, of which only those with a cell's centre are unpacked. No data and values that aren't finite go. Where scenes
    of one time overlap, the one with the greatest id stays.
    """
    from . import geotiff, rasters
    from .vectors import cells_in_boxes

    s = scenes.where(F.size("bbox") >= 4).withColumn("tid", F.coalesce(F.unix_timestamp("acquired"), F.lit(0).cast("bigint")))
    s = s.select("id", "tid", *[F.col("bbox")[k].alias(n) for k, n in enumerate("wsen")], F.explode(F.map_filter("bands", lambda k, v: k.isin(bands))).alias("band", "file"))
    boxes = s.select(F.col("id").alias("feature_no"), "w", "s", "e", "n").distinct()
    nth = F.row_number().over(Window.partitionBy("feature_no").orderBy("dggid"))
    cells = cells_in_boxes(boxes, grid, level).withColumn("nth", nth).where(F.col("nth") <= most).select(F.col("feature_no").alias("id"), "dggid", "lon", "lat")
    at = cells.join(s.select("id", "tid", "band", F.col("file.href").alias("path")), "id").join(headers, "path")
    east, north = F.col("lon"), F.col("lat")
    if "crs" in headers.columns:
        systems = [r.crs for r in headers.select("crs").distinct().limit(geotiff.MOST_SYSTEMS + 1).collect()]
        if len(systems) > geotiff.MOST_SYSTEMS:
            raise ValueError(f"more than {geotiff.MOST_SYSTEMS} reference systems")
        places = {crs: rasters.projected(F.col("lon"), F.col("lat"), crs) for crs in systems}
        east, north = (F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("crs") == crs, p[k]) for crs, p in places.items()]) for k in (0, 1))
    row, col = F.floor((F.col("north") - north) / F.col("pixel_height")), F.floor((east - F.col("west")) / F.col("pixel_width"))
    at = at.withColumns({"_row": row.cast("int"), "_col": col.cast("int")}).where((F.col("_row") >= 0) & (F.col("_col") >= 0) & (F.col("_row") < F.col("rows")) & (F.col("_col") < F.col("cols")))
    at = at.select("id", "tid", "band", "path", "dggid", "nodata", F.col("_row").alias("row"), F.col("_col").alias("col"))
    pixels = geotiff.values_at(at, pixels, headers) if "data" in pixels.columns else pixels
    x = at.join(pixels, ["path", "row", "col"]).where(~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("nodata").isNull() | (F.col("value") != F.col("nodata"))))
    return x.groupBy("dggid", "tid", F.col("band").alias("attr_key")).agg(F.max_by("value", "id").alias("value_num"))


def build_collection(items: DataFrame, name: str, collection: str, grid: HexLattice, box: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None, max_cloud: float | None = None, max_items: int = 50, level: int = 5) -> tuple[DataFrame, DataFrame]:
    """(collection, scenes): the newest scenes that a search finds, with the cells that they cover, and one row with name, scene_count, status and error."""
    found = newest(normalise(search(items, collection, box, start, end, max_cloud))).limit(max_items)
    scenes = found.join(coverage(found, grid, level), "id", "left")
    n = scenes.agg(F.count("*").alias("scene_count"))
    failed = F.col("scene_count") == 0
    row = n.select(F.lit(name).alias("name"), F.lit(collection).alias("collection"), "scene_count", F.when(failed, "failed").otherwise("ready").alias("status"), F.when(failed, "No scenes found matching criteria").alias("error"))
    return row, scenes


def chosen(scenes: DataFrame, ids: list[str]) -> DataFrame:
    """The scenes with these ids."""
    return scenes.where(F.col("id").isin(ids))
