"""Packed blocks of GeoTIFF files, the sink that writes them, and reference systems."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cellgrid.sources import geotiff, rasters
from cellgrid.sources.rasters import Raster, TransverseMercator


def files(spark, contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def texts(rng):
    yield b""
    yield b"a"
    yield bytes(5000)
    yield bytes(rng.randrange(256) for _ in range(20_000))
    yield bytes(rng.choice(b"ab") for _ in range(30_000))
    yield b"".join(bytes([rng.randrange(256)]) * rng.randrange(1, 300) for _ in range(200))


def test_packing_comes_back():
    for raw in texts(random.Random(1)):
        assert geotiff.unpacked_bits(geotiff.packed_bits(raw)) == raw
        assert geotiff.unpacked_lzw(geotiff.packed_lzw(raw)) == raw


def test_known_packings():
    """The example of the format's description of PackBits, and LZW codes written by hand: clear, 7, 7 7, 8, end, of nine bits each."""
    assert geotiff.unpacked_bits(bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22" + " AA" * 10)
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257))
    raw = int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    assert geotiff.unpacked_lzw(raw) == bytes([7, 7, 7, 8])
    with pytest.raises(ValueError):
        geotiff.unpacked_lzw(int("".join(f"{c:09b}" for c in (256, 7, 300)).ljust(32, "0"), 2).to_bytes(4, "big"))


@pytest.mark.parametrize("compression", [geotiff.PLAIN, geotiff.LZW, geotiff.DEFLATE, geotiff.PACKBITS])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("kind", ["uint8", "int16", "uint16", "float32", "float64"])
def test_files_come_back(compression, big, kind):
    v = (np.arange(70 * 45).reshape(70, 45) * 7 % 113).astype(kind)
    raw = geotiff.file_of(v, Raster(10.0, 50.0, 0.5, 0.25, 70, 45, -9999.0), 32, compression, big)
    assert geotiff.header_of(raw) == Raster(10.0, 50.0, 0.5, 0.25, 70, 45, -9999.0)
    got = np.zeros_like(v)
    for r, c, x in geotiff.blocks_of(raw):
        got[r : r + x.shape[0], c : c + x.shape[1]] = x
    assert (got == v).all()


def test_floating_predictor():
    """Bytes of a line by weight, each the difference from the one before it."""
    v = np.linspace(-3, 1e6, 24).astype("float32").reshape(4, 6)
    planes = v.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    data = np.diff(planes, axis=1, prepend=np.zeros((4, 1), np.uint8)).astype(np.uint8).tobytes()
    assert (geotiff.unpacked(4, 5, 6, 1, "<f4", geotiff.PLAIN, 3, data) == v[:, :5]).all()


def test_damaged_files():
    raw = geotiff.file_of(np.zeros((20, 20), "uint8"), Raster(0, 0, 1, 1, 20, 20), 16)
    for bad in (b"", b"II", b"nothing at all", raw[:60]):
        with pytest.raises(ValueError):
            geotiff.header_of(bad)
    with pytest.raises(ValueError):
        list(geotiff.blocks_of(raw[:-40]))


def test_only_blocks_with_a_place_are_unpacked(spark):
    """A hundred cells of a file of 4,096 by 4,096 pixels: at most as many blocks as places, and the values that a plain reader sees."""
    v = (np.arange(4096, dtype=np.int64)[:, None] * 31 + np.arange(4096) * 17).astype("uint16") % 5000
    raster = Raster(-20.0, 40.0, 0.01, 0.01, 4096, 4096)
    source = files(spark, {"a.tif": geotiff.file_of(v.astype("uint16"), raster, 256, geotiff.DEFLATE)})
    rng = random.Random(4)
    zones = [(f"z{k}", -20 + rng.random() * 41, 40 - rng.random() * 41) for k in range(100)]
    cells = spark.createDataFrame(zones, "dggid string, lon double, lat double")
    want = {z: float(v[r, c]) for z, x, y in zones if (r := math.floor((40 - y) / 0.01)) < 4096 and (c := math.floor((x + 20) / 0.01)) < 4096}
    got = geotiff.sample_files(source, cells, "k", 3).collect()
    assert {r.dggid: r.value_num for r in got} == want and {(r.tid, r.attr_key) for r in got} == {(3, "k")}
    places = spark.createDataFrame([("a.tif", math.floor((40 - y) / 0.01), math.floor((x + 20) / 0.01)) for z, x, y in zones if z in want], "path string, row int, col int")
    unpacked = geotiff.wanted_blocks(places, geotiff.blocks(source), geotiff.headers_of(source))
    few = places.where("row < 256 and col < 512")
    assert unpacked.count() <= 100 and geotiff.wanted_blocks(few, geotiff.blocks(source), geotiff.headers_of(source)).count() <= 2
    assert geotiff.blocks(source).count() == 256


def test_files_of_several_systems(spark):
    """Files in degrees, in the web's Mercator and in UTM, some without data at a place; the greatest path wins where they overlap."""
    v = np.arange(400, dtype="int32").reshape(20, 20)
    zone = rasters.utm_zone("EPSG:32633")
    gap = v.astype("float64")
    gap[5, 5] = np.nan
    gap[6, 6] = -1
    source = files(spark, {
        "a": geotiff.file_of(v, Raster(0.0, 10.0, 0.5, 0.5, 20, 20), 16), "b": geotiff.file_of(gap + 1000, Raster(5.0, 10.0, 0.5, 0.5, 20, 20, 999.0), 16),
        "c": geotiff.file_of(v + 5000, Raster(500_000.0, 5_600_000.0, 1000.0, 1000.0, 20, 20, crs="EPSG:32633"), 16),
    })
    lon, lat = zone.back(500_000 + 3500, 5_600_000 - 7500)
    cells = spark.createDataFrame([("left", 0.75, 9.75), ("both", 6.25, 8.25), ("nan", 7.75, 7.25), ("none", 8.25, 6.75), ("out", 50.0, 0.0), ("utm", lon, lat)], "dggid string, lon double, lat double")
    assert {r.dggid: r.value_num for r in geotiff.sample_files(source, cells, "k").collect()} == {"left": 1.0, "both": 1062.0, "nan": 5 * 20 + 15, "none": 6 * 20 + 16, "utm": 5000 + 7 * 20 + 3}
    assert geotiff.sample_files(files(spark, {}), cells, "k").count() == 0


def test_tiles_are_files_of_their_pixels(spark):
    rows = [(r, c, float(r * 50 + c)) for r in range(40) for c in range(50) if (r + c) % 7] + [(0, 0, None), (99, 0, 5.0), (1, 1, -3.0)]
    pixels = spark.createDataFrame(rows, "row int, col int, value double")
    for compression in (geotiff.LZW, geotiff.PACKBITS):
        out = geotiff.tiles(pixels, Raster(0.0, 40.0, 1.0, 1.0, 40, 50), 32, compression)
        assert sorted(r.path for r in out.select("path").collect()) == ["r0-c0.tif", "r0-c1.tif", "r1-c0.tif", "r1-c1.tif"]
        cells = pixels.select("row", "col").distinct().where("row < 40").selectExpr("concat(row, '-', col) AS dggid", "col + 0.5D AS lon", "40 - row - 0.5D AS lat")
        got = {r.dggid: r.value_num for r in geotiff.sample_files(out, cells, "k").collect()}
        assert got == {f"{r}-{c}": v for r, c, v in rows if v is not None and r < 40 and v >= 0}


def test_transverse_mercator(spark):
    """A worked example of the published map projection tables (Clarke 1866, 40.5 N 73.5 W, zone 18), and there and back to a millimetre."""
    clarke = TransverseMercator(-75.0, radius=6378206.4, flattening=1 - math.sqrt(1 - 0.00676866))
    from pyspark.sql import functions as F

    x, y = clarke.to(F.lit(-73.5), F.lit(40.5))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 627_106.5) < 0.06 and abs(r.y - 4_484_124.4) < 0.06
    rng = random.Random(9)
    for crs in ("EPSG:32601", "EPSG:32633", "EPSG:32760"):
        zone = rasters.utm_zone(crs)
        points = [(zone.middle + rng.uniform(-3.5, 3.5), rng.uniform(-80, 84)) for _ in range(50)]
        east, north = zone.to(F.col("lon"), F.col("lat"))
        for p in spark.createDataFrame(points, "lon double, lat double").select("lon", "lat", east.alias("x"), north.alias("y")).collect():
            lon, lat = zone.back(p.x, p.y)
            assert abs(lon - p.lon) < 1e-8 and abs(lat - p.lat) < 1e-8
    w, s, e, n = Raster(500_000.0, 5_600_000.0, 1000.0, 1000.0, 20, 20, crs="EPSG:32633").box()
    assert abs(w - 15) < 1e-6 and 50.3 < s < n < 50.6 and 15.2 < e < 15.4
    for bad in ("EPSG:32661", "EPSG:32600", "EPSG:2154", "nothing"):
        with pytest.raises(ValueError):
            rasters.projected(F.lit(0.0), F.lit(0.0), bad)


def test_scenes_in_their_own_systems(spark):
    """Bands of scenes from packed blocks, one file in UTM and one in degrees; the centre of each cell decides."""
    from cellgrid.grid import HexLattice
    from cellgrid.sources import stac, vectors

    grid, zone = HexLattice(), rasters.utm_zone("EPSG:32633")
    v = np.arange(3600, dtype="int32").reshape(60, 60)
    utm = Raster(400_000.0, 5_700_000.0, 3000.0, 3000.0, 60, 60, crs="EPSG:32633")
    plain = Raster(30.0, 52.0, 0.05, 0.05, 60, 60)
    source = files(spark, {"u": geotiff.file_of(v, utm, 16), "d": geotiff.file_of(v + 10_000, plain, 16)})
    band = lambda path: {"B04": {"href": path, "type": "image/tiff", "roles": ["data"]}}
    items = [("s1", "c", list(utm.box()), "2024-05-01T10:00:00Z", 5.0, band("u")), ("s2", "c", list(plain.box()), "2024-05-01T10:00:00Z", 5.0, band("d"))]
    scenes = stac.normalise(spark.createDataFrame(items, stac.ITEMS))
    names = [k for r in scenes.select("bands").collect() for k in r.bands]
    got = {r.dggid: r.value_num for r in stac.sample_scenes(scenes, geotiff.headers_of(source), geotiff.blocks(source), grid, 9, names).collect()}
    from pyspark.sql import functions as F

    want, boxes = {}, spark.createDataFrame([("u", *utm.box()), ("d", *plain.box())], "k string, w double, s double, e double, n double")
    east, north = zone.to(F.col("lon"), F.col("lat"))
    for r in vectors.cells_in_boxes(boxes, grid, 9).select("k", "dggid", "lon", "lat", east.alias("x"), north.alias("y")).collect():
        at = (math.floor((5_700_000 - r.y) / 3000), math.floor((r.x - 400_000) / 3000)) if r.k == "u" else (math.floor((52 - r.lat) / 0.05), math.floor((r.lon - 30) / 0.05))
        if all(0 <= i < 60 for i in at):
            want[r.dggid] = float(v[at] + 10_000 * (r.k == "d"))
    assert got == want and len(want) > 20 and {x >= 10_000 for x in want.values()} == {True, False}
