"""Rasters as pixel tables (row, col, value), sampled at cell centres; the rule for loading again, and demo layers."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import HexLattice


@dataclass(frozen=True)
class Raster:
    """A north-up raster: its west and north edges, pixel sizes in degrees, shape, and the value that means no data."""

    west: float
    north: float
    pixel_width: float
    pixel_height: float
    rows: int
    cols: int
    nodata: float | None = None
    crs: str = "EPSG:4326"

    def box(self) -> tuple[float, float, float, float]:
        """West, south, east and north in degrees."""
        e, s = self.west + self.cols * self.pixel_width, self.north - self.rows * self.pixel_height
        if self.crs in DEGREES:
            return self.west, s, e, self.north
        if self.crs == MERCATOR:
            turn = lambda x, y: (math.degrees(x / EARTH), math.degrees(2 * math.atan(math.exp(y / EARTH)) - math.pi / 2))
            return *turn(self.west, s), *turn(e, self.north)
        zone = utm_zone(self.crs)  # edges bend, so the box is that of many points on them
        at = [k / 64 for k in range(65)]
        edge = [(self.west + (e - self.west) * k, y) for k in at for y in (s, self.north)] + [(x, s + (self.north - s) * k) for k in at for x in (self.west, e)]
        lons, lats = zip(*[zone.back(x, y) for x, y in edge], strict=True)
        return min(lons), min(lats), max(lons), max(lats)


#: Reference systems in degrees, the web's Mercator, and its radius in metres.
DEGREES, MERCATOR, EARTH = ("EPSG:4326", "OGC:CRS84"), "EPSG:3857", 6378137.0


@dataclass(frozen=True)
class TransverseMercator:
    """A transverse Mercator projection of an ellipsoid, by Krueger's series in the third flattening (to the fourth power: below a millimetre within a zone)."""

    middle: float
    false_north: float = 0.0
    false_east: float = 500_000.0
    scale: float = 0.9996
    radius: float = EARTH
    flattening: float = 1 / 298.257223563

    def _series(self) -> tuple[float, float, list[float], list[float]]:
        """Eccentricity, the radius of the rectifying sphere, and the series' coefficients to the plane and back."""
        n = self.flattening / (2 - self.flattening)
        a = self.radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        to = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return math.sqrt(self.flattening * (2 - self.flattening)), a, to, back

    def to(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """East and north of a point in degrees; null a quarter of the way round and more."""
        ecc, a, to, _ = self._series()
        phi, lam = F.radians(lat), F.radians(F.pmod(lon - self.middle + 180, F.lit(360.0)) - 180)
        t = F.sinh(F.atanh(F.sin(phi)) - ecc * F.atanh(ecc * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
        x = eta + reduce(lambda v, k: v + to[k - 1] * F.cos(2 * k * xi) * F.sinh(2 * k * eta), range(1, 5), F.lit(0.0))
        y = xi + reduce(lambda v, k: v + to[k - 1] * F.sin(2 * k * xi) * F.cosh(2 * k * eta), range(1, 5), F.lit(0.0))
        near = (F.abs(lam) < math.pi / 2) & (F.abs(lat) < 90)
        return F.when(near, self.false_east + self.scale * a * x), F.when(near, self.false_north + self.scale * a * y)

    def back(self, east: float, north: float) -> tuple[float, float]:
        """Longitude and latitude of a point in the plane."""
        ecc, a, _, back = self._series()
        xi, eta = (north - self.false_north) / (self.scale * a), (east - self.false_east) / (self.scale * a)
        x, y = xi, eta
        for k, b in enumerate(back, 1):
            x -= b * math.sin(2 * k * xi) * math.cosh(2 * k * eta)
            y -= b * math.cos(2 * k * xi) * math.sinh(2 * k * eta)
        chi = math.asin(math.sin(x) / math.cosh(y))
        phi = chi
        for _ in range(6):  # the latitude whose conformal latitude is chi
            phi = math.asin(math.tanh(math.atanh(math.sin(chi)) + ecc * math.atanh(ecc * math.sin(phi))))
        return self.middle + math.degrees(math.atan2(math.sinh(y), math.cos(x))), math.degrees(phi)


def utm_zone(crs: str) -> TransverseMercator:
    """The projection of a UTM zone, EPSG:32601 to 32660 in the north and 32701 to 32760 in the south."""
    code = crs.removeprefix("EPSG:")
    if len(code) != 5 or code[:3] not in ("326", "327") or not code.isdecimal() or not 1 <= int(code[3:]) <= 60:
        raise ValueError(f"{crs} is not supported")
    return TransverseMercator(6.0 * int(code[3:]) - 183, 10_000_000.0 if code[2] == "7" else 0.0)


def projected(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """A point's coordinates in a raster's reference system."""
    if crs in DEGREES:
        return lon, lat
    if crs != MERCATOR:
        return utm_zone(crs).to(lon, lat)
    return F.radians(lon) * EARTH, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def level_range(least: int | None = None, most: int | None = None, default: tuple[int, int] = (1, 10)) -> range:
    """The levels to load: those from one bound to the other, the one that is given, or the default ones."""
    a = least if least is not None else most if most is not None else default[0]
    b = most if most is not None else least if least is not None else default[1]
    return range(min(a, b), max(a, b) + 1)


def zones_of_levels(spark: SparkSession, grid: HexLattice, levels: range, box: tuple[float, float, float, float], most: int | None = None) -> DataFrame:
    """The cells of all levels whose centre is in a box: (dggid, lon, lat), at most `most` of each level in id order."""
    return reduce(DataFrame.unionByName, [grid.list_zones(spark, k, *box, most) for k in levels])


def sample(pixels: DataFrame, raster: Raster, zones: DataFrame, key: str, tid: int = 0, clamp: bool = False, least: float | None = None) -> DataFrame:
    """The pixel at each zone's centre (dggid, lon, lat) as a cell object.

    Centres outside go, or take the edge's pixel with `clamp`. No data, values that aren't finite and those below `least` go.
    """
    x, y = projected(F.col("lon"), F.col("lat"), raster.crs)
    col = F.floor((x - raster.west) / raster.pixel_width).cast("bigint")
    row = F.floor((F.lit(raster.north) - y) / raster.pixel_height).cast("bigint")
    if clamp:
        col, row = F.greatest(F.lit(0), F.least(F.lit(raster.cols - 1), col)), F.greatest(F.lit(0), F.least(F.lit(raster.rows - 1), row))
    v = pixels.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value_num"))
    x = cleaned(zones.select("dggid", row.alias("row"), col.alias("col"), F.lit(raster.nodata).cast("double").alias("nodata")).join(v, ["row", "col"]))
    if least is not None:
        x = x.where(F.col("value_num") >= least)
    return x.select("dggid", F.lit(tid).cast("bigint").alias("tid"), F.lit(key).alias("attr_key"), "value_num")


def cleaned(cells: DataFrame) -> DataFrame:
    """Rows whose value_num is a finite number other than their nodata."""
    v = F.col("value_num")
    return cells.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (F.col("nodata").isNull() | (v != F.col("nodata"))))


def to_ingest(manifest: DataFrame, datasets: DataFrame) -> DataFrame:
    """Manifest rows (name, min_lvl, max_lvl) to load: new ones, and those whose dataset isn't ready or has other levels."""
    have = datasets.where("status in ('ready', 'active')").select("name", F.get_json_object("metadata", "$.min_lvl").try_cast("int").alias("min_lvl"), F.get_json_object("metadata", "$.max_lvl").try_cast("int").alias("max_lvl"))
    return manifest.join(have, ["name", "min_lvl", "max_lvl"], "left_anti")


def _draw(key: str, *salt: str) -> Column:
    """A number from 0 to 1 by a hash of the cell's id, so that runs agree."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(key), *map(F.lit, salt), F.col("dggid")).cast("binary")), 1, 8), 16, 10)
    return F.pmod(h.cast("bigint"), F.lit(1_000_000)) / 1_000_000


def synthetic(zones: DataFrame, key: str, classes: dict[str, int] | None = None, low: float = 0.0, high: float = 1.0, pattern: str | None = None) -> DataFrame:
    """A demo layer on the zones: weighted classes, or values between two bounds, evenly or by a pattern.

    Patterns: temperature falls from the middle of the zones' latitudes to both ends; ocean_depth and elevation are spread
    normally, with some trenches and shallows, mountains and lowlands.
    """
    tid, attr, u = F.lit(0).cast("bigint").alias("tid"), F.lit(key).alias("attr_key"), _draw(key)
    if classes:
        total, upto, label = sum(classes.values()), 0, F.lit(None).cast("string")
        for name, weight in classes.items():
            upto += weight
            label = F.coalesce(label, F.when(u < upto / total, F.lit(name)))
        return zones.select("dggid", tid, attr, label.alias("value_text"))
    between = lambda a, b, *salt: F.lit(a) + (b - a) * _draw(key, *salt)
    normal = F.sqrt(-2 * F.log(_draw(key, "r") + 1e-6)) * F.cos(2 * math.pi * _draw(key, "t"))
    kind = _draw(key, "kind")
    if pattern == "temperature":
        ends = zones.agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"))
        zones = zones.crossJoin(F.broadcast(ends))
        middle = 1 - F.abs(2 * F.coalesce((F.col("lat") - F.col("_s")) / F.nullif(F.col("_n") - F.col("_s"), F.lit(0.0)), F.lit(0.5)) - 1)
        v, digits = F.lit(low) + (high - low) * middle + between(-5.0, 5.0, "noise"), 1
    elif pattern == "ocean_depth":
        v, digits = F.when(kind < 0.05, between(-8000.0, -6000.0, "deep")).when(kind < 0.1925, between(-200.0, 0.0, "shallow")).otherwise(-3000 + 1500 * normal), 0
    elif pattern == "elevation":
        v, digits = F.when(kind < 0.1, between(2000.0, 4500.0, "high")).when(kind < 0.28, between(0.0, 200.0, "low")).otherwise(500 + 400 * normal), 0
    elif pattern is None:
        v, digits = F.lit(low) + (high - low) * u, None
    else:
        raise ValueError(f"unknown pattern {pattern}")
    v = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))
    return zones.select("dggid", tid, attr, (v if digits is None else F.round(v, digits)).alias("value_num"))


@dataclass(frozen=True)
class DemoLayer:
    """A layer's name, level, box (west, south, east, north), attribute, and its weighted classes or its bounds and pattern."""

    name: str
    level: int
    box: tuple[float, float, float, float]
    key: str
    classes: dict[str, int] | None = None
    low: float = 0.0
    high: float = 1.0
    pattern: str | None = None


#: The layers of a new installation; weights in percent.
DEMO_LAYERS = (
    DemoLayer("Global Regions (Lv2)", 2, (-140, -70, 140, 70), "region", {"region_a": 40, "region_b": 35, "region_c": 25}),
    DemoLayer("Protected Areas (Lv3)", 3, (-130, 20, -60, 55), "protection_class", {"national_park": 50, "wildlife_reserve": 30, "marine_protected": 20}),
    DemoLayer("Ocean Bathymetry (Lv4)", 4, (-180, -75, 180, 75), "depth", None, -8000, 0, "ocean_depth"),
    DemoLayer("Global Temperature (Lv4)", 4, (-180, -80, 180, 80), "temp_celsius", None, -30, 45, "temperature"),
    DemoLayer("Global Elevation (Lv4)", 4, (-180, -70, 180, 70), "elevation", None, 0, 4500, "elevation"),
    DemoLayer("North America Climate (Lv5)", 5, (-130, 24, -65, 55), "temp_celsius", None, -20, 35, "temperature"),
    DemoLayer("Europe Climate (Lv5)", 5, (-10, 35, 40, 70), "temp_celsius", None, -10, 30, "temperature"),
    DemoLayer("South America Elevation (Lv5)", 5, (-80, -55, -35, 12), "elevation", None, 0, 6500, "elevation"),
)


def demo_layer(spark: SparkSession, grid: HexLattice, layer: DemoLayer) -> DataFrame:
    """One demo layer on the cells of its box."""
    return synthetic(grid.list_zones(spark, layer.level, *layer.box), layer.key, layer.classes, layer.low, layer.high, layer.pattern)
