"""Vector features burned into cells."""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import HexLattice
from .cover import cover_boxes, cover_polygons, expanded
from .rasters import EARTH, TransverseMercator


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature_no, kind, coordinates (as JSON) and properties (a map) of a feature collection's points and polygons."""
    x = spark.read.option("multiLine", True).schema("features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>").json(path)
    f = x.select(F.posexplode("features").alias("feature_no", "f"))
    return f.select("feature_no", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties")).where(F.col("kind").isin("Point", "Polygon", "MultiPolygon"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from newline-delimited GeoJSON, one feature a line, which Spark splits at any size; features are numbered in the order of the lines of a file's parts."""
    x = spark.read.schema("geometry struct<type:string,coordinates:string>, properties map<string,string>").json(path)
    f = x.select(F.monotonically_increasing_id().alias("feature_no"), F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"), "properties")
    return f.where(F.col("kind").isin("Point", "Polygon", "MultiPolygon"))


def shapes_of(shp: bytes, dbf: bytes) -> list[tuple[int, str, str, dict[str, str]]]:
    """(number, kind, coordinates as JSON, properties) of the points and polygons of a shapefile and its table."""
    n, head, width = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    rows = []
    for k in range(n):
        raw, at, row = dbf[head + k * width : head + (k + 1) * width], 1, {}
        for name, size in fields:
            row[name] = raw[at : at + size].decode("utf-8", "replace").strip()
            at += size
        rows.append(row)
    out, at, k = [], 100, 0
    while at + 12 <= len(shp):
        size = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        body, at, kind = shp[at + 8 : at + 8 + size], at + 8 + size, struct.unpack("<i", shp[at + 8 : at + 12])[0]
        properties = rows[k] if k < n else {}
        if kind % 10 == 1:  # points, also with heights and measures
            out.append((k, "Point", json.dumps(struct.unpack("<2d", body[4:20])), properties))
        elif kind % 10 == 5:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            polygons: list[list] = []
            for a, z in zip(starts, starts[1:], strict=False):
                ring = [[flat[2 * i], flat[2 * i + 1]] for i in range(a, z)]
                clockwise = sum((q[0] - p[0]) * (q[1] + p[1]) for p, q in zip(ring, ring[1:], strict=False)) >= 0
                if clockwise or not polygons:  # outer rings are clockwise, holes are not
                    polygons.append([])
                polygons[-1].append(ring)
            out.append((k, "MultiPolygon", json.dumps(polygons), properties))
        k += 1
    return out


def degrees_by(prj: str | None) -> Callable[[float, float], tuple[float, float]] | None:
    """How a shapefile's coordinates become degrees, by the text of its .prj; None if they are degrees (or nothing is said).

    Transverse Mercator (UTM among them) and the web's Mercator are known, in any unit of length; others are an error, since
    their shapes would land in wrong cells.
    """
    text = (prj or "").strip()
    if not text or text.upper().startswith(("GEOGCS", "GEOGCRS")):
        return None
    named = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["(\w+)",\s*([-+.\deE]+)\]', text)}
    kind = (re.search(r'PROJECTION\["(\w+)"', text) or ["", ""])[1].lower()
    radius, inverse = next(((float(m[1]), float(m[2])) for m in re.finditer(r'(?:SPHEROID|ELLIPSOID)\["[^"]*",\s*([\d.]+),\s*([\d.]+)', text)), (EARTH, 298.257223563))
    unit = float(([("", "1")] + re.findall(r'UNIT\["([^"]*)",\s*([-+.\deE]+)', text))[-1][1])
    east, north = named.get("false_easting", 0.0) * unit, named.get("false_northing", 0.0) * unit
    if kind == "transverse_mercator" and not named.get("latitude_of_origin"):
        plane = TransverseMercator(named.get("central_meridian", 0.0), north, east, named.get("scale_factor", 1.0), radius, 1 / inverse if inverse else 0.0)
        return lambda x, y: plane.back(x * unit, y * unit)
    if kind in ("mercator_auxiliary_sphere", "popular_visualisation_pseudo_mercator"):
        middle = named.get("central_meridian", 0.0)
        return lambda x, y: (middle + math.degrees((x * unit - east) / EARTH), math.degrees(2 * math.atan(math.exp((y * unit - north) / EARTH)) - math.pi / 2))
    raise ValueError(f"the projection {kind or text[:40]} of a shapefile is not supported")


def _turned(c: list, turn: Callable[[float, float], tuple[float, float]]) -> list:
    """Nested coordinates with every point turned."""
    return list(turn(c[0], c[1])) if c and not isinstance(c[0], list) else [_turned(x, turn) for x in c]


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Points and polygons of a shapefile (the .shp with its .dbf and, if there is one, its .prj beside it), in degrees; other shapes are left out. Each file is read by one task."""
    files = spark.read.format("binaryFile").load(path[:-4] + ".{shp,dbf,prj}").select("path", "content")
    part = lambda kind: F.max(F.when(F.col("path").endswith("." + kind), F.col("content"))).alias(kind)
    whole = files.groupBy(F.regexp_replace("path", r"\.(shp|dbf|prj)$", "").alias("base")).agg(part("shp"), part("dbf"), part("prj"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        for b in batches:
            for shp, dbf, prj in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                rows, turn = shapes_of(shp, dbf), degrees_by(prj.decode("utf-8", "replace") if prj else None)
                places = [json.dumps(_turned(json.loads(r[2]), turn)) if turn else r[2] for r in rows]
                columns = [[r[0] for r in rows], [r[1] for r in rows], places, [list(r[3].items()) for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["feature_no", "kind", "coordinates", "properties"])

    return whole.mapInArrow(read, "feature_no bigint, kind string, coordinates string, properties map<string,string>")


def burn(features: DataFrame, grid: HexLattice, level: int, attribute: str | None = None) -> DataFrame:
    """Cells (dggid, tid, attr_key, value_num): a point's cell, and the cells whose centre a polygon holds (holes excluded).

    The value is the attribute's number, or 1. Of several features at a cell the last one stays. Each polygon is
    covered from coarse cells to fine ones along its edge, so features are never paired with the whole grid.
    """
    value = F.coalesce(F.col("properties")[attribute].try_cast("double"), F.lit(1.0)) if attribute else F.lit(1.0)
    x = features.withColumn("value_num", value)
    points = x.where("kind = 'Point'").withColumn("c", F.from_json("coordinates", "array<double>"))
    points = points.select("feature_no", grid.zone_at_point(F.col("c")[0], F.col("c")[1], level).alias("dggid"), "value_num")
    polys = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>"))).otherwise(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    p = x.where("kind != 'Point'").select("feature_no", "value_num", F.explode(polys).alias("rings"))
    rings = F.transform("rings", lambda ring: F.transform(ring, lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat"))))
    p = p.withColumn("rings", rings).where(F.size(F.col("rings")[0]) >= 3)
    inside = expanded(cover_polygons(p, grid, level), grid, level)
    cells = points.unionByName(inside.select("feature_no", "dggid", "value_num")).where("dggid is not null")
    last = Window.partitionBy("dggid").orderBy(F.desc("feature_no"), F.desc("value_num"))
    return cells.withColumn("k", F.row_number().over(last)).where("k = 1").select("dggid", F.lit(0).cast("bigint").alias("tid"), F.lit(attribute or "value").alias("attr_key"), "value_num")


def cells_in_boxes(p: DataFrame, grid: HexLattice, level: int) -> DataFrame:
    """p with the cells (dggid, lon, lat) whose centre is in its box w, s, e, n."""
    z = expanded(cover_boxes(p, grid, level), grid, level).drop("cell_level").withColumn("_c", F.explode(F.array(grid.centroid(F.col("dggid")))))
    return z.select("*", F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat")).drop("_c")
