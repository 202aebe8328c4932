"""Sources, sinks, catalogue, access, models and streams."""

from __future__ import annotations

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cellgrid import access, catalog, ml
from cellgrid.functions import values as V
from cellgrid.grid import HexLattice
from cellgrid.schema import DATASETS
from cellgrid.sources import rasters, sinks, stac, tables, vectors
from cellgrid.streaming import cells as stream

LAT = HexLattice()


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "c.csv").write_text("zone,time,key,value\nA1,3,t,1.5\nA2,x,t,warm\n,1,t,2\nA3,2,,4\nA4,1,t,\n")
    got = {r.dggid: (r.tid, r.value_num, r.value_text) for r in tables.read_csv(spark, str(tmp_path / "c.csv"), "d").collect()}
    assert got == {"A1": (3, 1.5, None), "A2": (0, None, "warm"), "A4": (1, None, None)}
    records = [{"dggid": "B1", "attr_key": "k", "tid": 1, "value": "7"}, {"dggid": "B2", "attr": "k", "value": 2.5}]
    for k, content in enumerate((records, {"cells": records})):
        (tmp_path / f"c{k}.json").write_text(json.dumps(content))
        assert {(r.dggid, r.tid, r.value_num) for r in tables.read_json(spark, str(tmp_path / f"c{k}.json")).collect()} == {("B1", 1, 7.0), ("B2", 0, 2.5)}


def test_typed_values(spark):
    raw = ["1e3", " 2 ", "", None, '{"a": 1}', "[1,2]", "{bad", "text"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(raw)], "k int, v string")
    got = [(r.value_num, r.value_json, r.value_text) for r in df.select("k", *[c.alias(n) for n, c in V.typed_value(F.col("v")).items()]).orderBy("k").collect()]
    assert got == [(1000.0, None, None), (2.0, None, None), (None, None, None), (None, None, None), (None, '{"a": 1}', None), (None, "[1,2]", None), (None, None, "{bad"), (None, None, "text")]


def test_store_and_merge(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "dggid string, tid bigint, attr_key string, value_num double")
    path = str(tmp_path / "store")
    tables.write_dataset(make([("a", 0, "k", 1.0), ("b", 0, "k", 2.0)]), path, "one")
    tables.write_dataset(make([("a", 0, "k", 9.0)]), path, "two")
    assert tables.read_dataset(spark, path, "two").first().value_num == 9.0 and tables.read_dataset(spark, path).count() == 3
    old, new = make([("a", 0, "k", 1.0), ("b", 0, "k", 2.0)]), make([("b", 0, "k", 5.0), ("c", 0, "k", 6.0), ("c", 0, "k", 7.0)])
    values = lambda df: {r.dggid: r.value_num for r in df.collect()}
    assert values(tables.upsert(old, new)) == {"a": 1.0, "b": 5.0, "c": 7.0}
    assert values(tables.insert_ignore(old, new)) == {"a": 1.0, "b": 2.0, "c": 7.0}


def test_vectors(spark, tmp_path):
    box = [[-75, 40], [-74, 40], [-74, 41], [-75, 41], [-75, 40]]
    hole = [[-74.6, 40.4], [-74.4, 40.4], [-74.4, 40.6], [-74.6, 40.6], [-74.6, 40.4]]
    parts = [({"type": "Point", "coordinates": [-74.006, 40.7128]}, {"temp": 25.5}), ({"type": "Polygon", "coordinates": [box, hole]}, {"cat": 5}), ({"type": "LineString", "coordinates": box}, {})]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": p} for g, p in parts]}))
    f = vectors.read_geojson(spark, str(tmp_path / "f.json"))
    point = vectors.burn(f.where("kind = 'Point'"), LAT, 7, "temp").collect()
    assert len(point) == 1 and point[0].value_num == 25.5
    burned = vectors.burn(f.where("kind = 'Polygon'"), LAT, 9, "cat")
    zones = LAT.list_zones(spark, 9, -75, 40, -74, 41)
    inside = {r.dggid for r in zones.where("not (lon between -74.6 and -74.4 and lat between 40.4 and 40.6)").collect()}
    assert {r.dggid for r in burned.collect()} == inside and len(inside) > 0 and {r.value_num for r in burned.collect()} == {5.0}


def test_rasters(spark):
    raster = rasters.Raster(0.0, 10.0, 1.0, 1.0, 10, 10, nodata=-1.0)
    pixels = spark.createDataFrame([(r, c, -1.0 if (r, c) == (3, 3) else float(10 * r + c)) for r in range(10) for c in range(10)], "row int, col int, value double")
    zones = spark.createDataFrame([("a", 0.5, 9.5), ("b", 3.2, 6.5), ("c", 12.0, 5.0), ("d", 9.9, 0.1)], "dggid string, lon double, lat double")
    assert {r.dggid: r.value_num for r in rasters.sample(pixels, raster, zones, "k").collect()} == {"a": 0.0, "d": 99.0}
    assert {r.dggid: r.value_num for r in rasters.sample(pixels, raster, zones, "k", clamp=True).collect()} == {"a": 0.0, "d": 99.0, "c": 59.0}
    layer = rasters.synthetic(zones, "land", {"forest": 3, "water": 1})
    assert {r.value_text for r in layer.collect()} <= {"forest", "water"} and layer.collect() == rasters.synthetic(zones, "land", {"forest": 3, "water": 1}).collect()


def test_scenes(spark):
    asset = lambda t, roles=None: {"href": f"h/{t}", "type": t, "roles": roles or []}
    items = spark.createDataFrame([("s1", "c", [-10.0, -10.0, 10.0, 10.0], "2024-05-01T10:00:00Z", 5.0, {"B02": asset("image/tiff; application=geotiff"), "meta": asset("text/xml"), "thumbnail": asset("image/png")}), ("s2", "c", [50.0, 50.0, 60.0, 60.0], "2024-06-01T10:00:00Z", 80.0, {"B03": asset("image/jp2", ["data"])})], stac.ITEMS)
    assert [r.id for r in stac.search(items, "c", (-5, -5, 5, 5), "2024-01-01T00:00:00Z", None, 20).collect()] == ["s1"]
    scenes = stac.normalise(items)
    rows = {r.id: r for r in scenes.collect()}
    assert set(rows["s1"].bands) == {"B02"} and set(rows["s2"].bands) == {"B03"} and rows["s1"].thumbnail == "h/image/png" and rows["s1"].acquired == datetime(2024, 5, 1, 10)
    assert set({r.id: r for r in stac.normalise(items, {"B02": "blue"}).collect()}["s1"].bands) == {"blue"}
    assert stac.all_bands(scenes).first().bands == ["B02", "B03"] and [(r.id, r.missing) for r in stac.missing_bands(scenes, ["B02"]).collect()] == [("s2", ["B02"])]
    covered = stac.coverage(scenes, LAT, 5)
    assert {r.id: r.zone_count for r in covered.collect()}["s1"] == LAT.list_zones(spark, 5, -10, -10, 10, 10).count()
    assert stac.collections(scenes, covered).first().scenes == 2 and [r.id for r in stac.newest(scenes).collect()] == ["s2", "s1"]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("C3-1-1", 0, "k", None, 2.0, None)], "dggid string, tid bigint, attr_key string, value_text string, value_num double, value_json string")
    sinks.write_csv(c, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().value_num == "2.0"
    f = json.loads(sinks.features(c, LAT.centroid(F.col("dggid"))).first().feature)
    assert f["geometry"]["type"] == "Point" and f["properties"]["value_num"] == 2.0
    p = sinks.polygons(c, LAT.vertices(F.col("dggid")), LAT.level(F.col("dggid")))
    assert p.first().wkt.startswith("POLYGON((") and sinks.cache_get(sinks.cache_put(p, p), p).count() == 1


def test_catalogue(spark):
    at = datetime(2024, 1, 1)
    rows = [("1", "Result of buffer", None, "g", 3, "u", "active", "private", [], '{"source":"spatial_op","rows":"5"}', at), ("2", "land_cover%", None, "g", 3, "u", "active", "public", [], "{}", at), ("3", "mine", None, "g", 3, "v", "active", "shared", ["w"], None, at)]
    d = spark.createDataFrame(rows, DATASETS)
    now = F.lit(datetime(2024, 1, 3))
    assert [r.id for r in catalog.expired(d, 24, now).collect()] == ["1"] and catalog.expired(d, 72, now).count() == 0
    merged = {r.id: json.loads(r.metadata or "{}") for r in catalog.merge_metadata(d, "1", {"rows": "6", "x": None, "y": "z"}).collect()}
    assert merged["1"] == {"source": "spatial_op", "rows": "6", "y": "z"} and merged["2"] == {}
    kept = json.loads(catalog.merge_metadata(d, "1", {"levels": [1, 2.5], "deep": {"a": True}, "n": 3}).where("id = '1'").first().metadata)
    assert kept == {"source": "spatial_op", "rows": "5", "levels": [1, 2.5], "deep": {"a": True}, "n": 3}
    named = spark.createDataFrame([(str(k), n, None, "g", 3, "u", "active", "private", [], m, at) for k, (n, m) in enumerate((
        ("Buffer Result", None), ("Results of x", None), ("x", '{"source":"Operation"}'), ("x", '{"type":"buffer","parents":["1"]}'), ("x", '{"type":"buffer"}'), ("x", '{"type":"buffer","parents":"1"}'), ("a result b", None), ("x", '{"source":"analysis"}')))], DATASETS)
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(named.where(catalog.is_result())) == {"0", "2", "3", "6"} and ids(catalog.split_results(named)[0]) == {"1", "4", "5", "7"}
    assert ids(catalog.expired(named, 1, now)) == set() and ids(named.where(catalog.is_leftover())) == {"0", "3", "5", "6"}
    see = lambda user, role="viewer": {r.id for r in d.where(access.visible_datasets(user, role)).collect()}
    assert see("w") == {"2", "3"} and see("u") == {"1", "2"} and see(None) == {"2"} and see("x", "admin") == {"1", "2", "3"}
    assert access.may("editor", "edit_own_dataset") and not access.may("viewer", "run_any_operation") and not access.may("nobody", "view_any_dataset")
    assert {r.id for r in d.where(access.may_change("v", "editor")).collect()} == {"3"} and d.where(access.may_change("v", "viewer")).count() == 0 and d.where(access.may_change(None, "admin")).count() == 3
    assert catalog.new_dataset(spark, "n", "g").first().status == "active"
    from cellgrid.operators.query import search_datasets

    assert [r.id for r in search_datasets(d, "COVER%").collect()] == ["2"]
    for bad in ("drop table x", "select 1; select 2", ""):
        with pytest.raises(ValueError):
            catalog.explain_query(spark, bad)
    assert "Physical Plan" in catalog.explain_query(spark, "select 1 as a")


def test_annotations(spark):
    a = spark.createDataFrame([(1, "a <script>x</script>note", "public", "u"), (2, "b", "private", "u"), (3, "c\x01", "shared", "u")], "id bigint, content string, visibility string, created_by string")
    s = spark.createDataFrame([(3, "w"), (3, "w"), (2, "w")], "annotation_id bigint, user_id string")
    assert {r.id for r in access.visible_annotations(a, s, "w").collect()} == {1, 3} and access.visible_annotations(a, s, "u").count() == 3
    assert {r.content for r in access.cleaned_annotations(a).collect()} == {"a note", "b", "c"}


def test_checks():
    assert V.check_id("B0-0-A") == "B0-0-A" and V.identifier("1 a-b") == "_1_a_b"
    for bad in (lambda: V.check_id("a b"), lambda: V.check_id("x" * 257), lambda: V.check_box(0, 10, 1, 5), lambda: V.check_uuid("x"), lambda: V.check_choice("a", ("b",))):
        with pytest.raises(ValueError):
            bad()


def test_cache(spark):
    now, made = [0.0], []
    cache = catalog.TableCache(lambda: now[0])
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get("viewport", "a", make).count() == cache.get("viewport", "a", make).count() == 3 and len(made) == 1
    now[0] = 301
    cache.get("viewport", "a", make)
    cache.drop("viewport", "a")
    assert len(made) == 2


def test_models(spark, tmp_path):
    wide = spark.createDataFrame([(f"c{k}", 0, float(k), 3.0 * k + 1) for k in range(200)], "dggid string, tid bigint, x double, y double")
    model, metrics = ml.train(wide, ["x"], "y")
    assert metrics["rmse"] < 1e-6 and ml.predict(model, wide, ["x"]).count() == 200
    for kind in ("lstm", "cnn", "xgboost"):
        with pytest.raises(ValueError):
            ml.train(wide, ["x"], "y", kind)
    model_id = ml.save_model(model, spark, str(tmp_path / "models"), "linear_regression", "y", ["x"], metrics)
    assert ml.list_models(spark, str(tmp_path / "models")).first().model_id == model_id and ml.model_info(spark, str(tmp_path / "models"), model_id).first().target == "y"
    assert ml.predict(ml.load_model(spark, str(tmp_path / "models"), model_id), wide, ["x"]).count() == 200
    with pytest.raises(ValueError):
        ml.load_model(spark, str(tmp_path / "models"), "none")
    risk = ml.fire_risk(wide.select("dggid", (F.col("x") / 200).alias("value_num")), "extreme").collect()
    assert all(0 <= r.score <= 1 for r in risk) and ml.services(spark).count() == 1


def test_stream(spark, tmp_path):
    schema = "ts timestamp, dggid string, attr_key string, value_num double"
    day = lambda rows: spark.createDataFrame([(datetime(2024, 1, 1, h, m), d, "k", v) for h, m, d, v in rows], schema)
    day([(0, 5, "a", 1.0), (0, 50, "a", 3.0), (1, 10, "a", 5.0)]).write.parquet(str(tmp_path / "in"))
    q = stream.merge_batches(stream.hourly_cells(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    day([(0, 20, "a", 8.0), (2, 0, "b", 2.0)]).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    base = 1704067200 // 3600
    assert {(r.dggid, r.tid - base): r.value_num for r in stream.merged(spark, str(tmp_path / "out")).collect()} == {("a", 0): 4.0, ("a", 1): 5.0, ("b", 2): 2.0}


def readings(spark, rows):
    return spark.createDataFrame(rows, "dggid string, tid bigint, attr_key string, value_num double")


def table_at(spark, path):
    return {(r.dggid, r.tid): r.value_num for r in stream.merged(spark, path).collect()}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    stream.merge_batch(readings(spark, [("a", 1, "k", 1.0), ("b", 30, "k", 2.0)]), 0, path)
    stream.merge_batch(readings(spark, [("a", 1, "k", 5.0)]), 1, path)
    _, before = stream.current(spark, path)
    stream.merge_batch(readings(spark, [("a", 1, "k", 9.0)]), 1, path)
    stream.merge_batch(readings(spark, [("a", 1, "k", 9.0)]), 0, path)
    assert table_at(spark, path) == {("a", 1): 5.0, ("b", 30): 2.0} and stream.current(spark, path) == (1, before)
    assert "/0-" in before["1"] and "/1-" in before["0"]  # only the part that the batch touched was written anew
    stream.merge_batch(readings(spark, []), 2, path)
    stream.remove_old(spark, path)
    assert stream.current(spark, path)[0] == 2 and table_at(spark, path) == {("a", 1): 5.0, ("b", 30): 2.0}
    assert len(list((tmp_path / "t" / "versions").glob("*.json"))) == 1


def test_whoever_dies_before_the_version_is_named_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    stream.merge_batch(readings(spark, [("a", 1, "k", 1.0)]), 0, path)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(stream, "name_version", dies)
        with pytest.raises(RuntimeError):
            stream.merge_batch(readings(spark, [("a", 1, "k", 7.0), ("c", 2, "k", 3.0)]), 1, path)
    assert stream.current(spark, path)[0] == 0 and table_at(spark, path) == {("a", 1): 1.0}
    stream.merge_batch(readings(spark, [("a", 1, "k", 7.0), ("c", 2, "k", 3.0)]), 1, path)
    assert table_at(spark, path) == {("a", 1): 7.0, ("c", 2): 3.0}


def test_rows_by_key(spark):
    t = readings(spark, [("a", 1, "k", 1.0), (None, 1, "k", 2.0)])
    key = tables.keyed(("dggid", "tid", "attr_key"), ("a", 1, "k"))
    assert tables.get_row(t, key).first().value_num == 1.0 and tables.delete_row(t, key).first().value_num == 2.0
    assert sorted(r.value_num for r in tables.update_row(t, key, {"value_num": 4}).collect()) == [2.0, 4.0]
    for bad in (lambda: tables.keyed(("a", "b"), "x"), lambda: tables.keyed(("a",), {"b": 1}), lambda: tables.update_row(t, key, {"nothing": 1}), lambda: tables.get_row(t, {})):
        with pytest.raises(ValueError):
            bad()


def tiff(values, tile=None, deflate=False, predictor=False, order="<", nodata="-9999", code=4326, at=(10.0, 50.0), size=0.5):
    """A GeoTIFF file of one band, in strips of two rows or in tiles."""
    import struct
    import zlib

    import numpy as np

    v = np.asarray(values)
    rows, cols = v.shape
    kind = {"u": 1, "i": 2, "f": 3}[v.dtype.kind]
    high, wide = tile or (2, cols)
    blocks = []
    for r in range(0, rows, high):
        for c in range(0, cols, wide):
            b = np.zeros((high, wide), v.dtype)
            part = v[r : r + high, c : c + wide]
            b[: part.shape[0], : part.shape[1]] = part
            b = b if tile else b[: part.shape[0]]
            b = np.diff(b, axis=1, prepend=b.dtype.type(0)) if predictor else b
            raw = b.astype(v.dtype.newbyteorder(order)).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    tags = [(256, "H", [cols]), (257, "H", [rows]), (258, "H", [v.dtype.itemsize * 8]), (259, "H", [8 if deflate else 1]), (277, "H", [1]), (317, "H", [2 if predictor else 1])]
    sizes = [len(b) for b in blocks]
    if tile:
        tags += [(322, "H", [wide]), (323, "H", [high]), (324, "I", None), (325, "I", sizes)]
    else:
        tags += [(273, "I", None), (278, "H", [high]), (279, "I", sizes)]
    tags += [(339, "H", [kind]), (33550, "d", [size, size, 0.0]), (33922, "d", [0.0, 0.0, 0.0, *at, 0.0]), (34735, "H", [1, 1, 0, 1, 2048 if code == 4326 else 3072, 0, 1, code]), (42113, "s", nodata.encode() + b"\0")]
    tags.sort()
    first, data, entries = 8 + 2 + 12 * len(tags) + 4, b"", b""
    room = sum(0 if len(x or blocks) * struct.calcsize(f) <= 4 else len(x or blocks) * struct.calcsize(f) for _, f, x in tags)
    starts = [first + room + sum(sizes[:k]) for k in range(len(blocks))]
    for tag, f, x in tags:
        x = starts if x is None else x
        raw = x if f == "s" else struct.pack(f"{order}{len(x)}{f}", *x)
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[f], len(x))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "I", first + len(data))
            data += raw
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0"
    return head + data + b"".join(blocks)


@pytest.mark.parametrize("options", [{}, {"tile": (16, 16), "deflate": True}, {"deflate": True, "predictor": True}, {"order": ">"}, {"tile": (16, 16), "order": ">", "predictor": True, "deflate": True}])
@pytest.mark.parametrize("kind", ["uint8", "int16", "float32"])
def test_geotiff(spark, tmp_path, options, kind):
    import numpy as np

    from cellgrid.sources import geotiff

    if kind == "float32":
        options = {k: v for k, v in options.items() if k != "predictor"}
    values = (np.arange(21 * 37).reshape(21, 37) % 101).astype(kind)
    (tmp_path / "a.tif").write_bytes(tiff(values, **options))
    blocks = np.full(values.shape, -1.0)
    for r, c, v in geotiff.blocks_of((tmp_path / "a.tif").read_bytes()):
        blocks[r : r + v.shape[0], c : c + v.shape[1]] = v
    assert (blocks == values).all()
    if options.get("tile") and kind == "int16":
        raster = geotiff.raster_of(geotiff.read_headers(spark, str(tmp_path / "a.tif")))
        assert raster == rasters.Raster(10.0, 50.0, 0.5, 0.5, 21, 37, -9999.0, "EPSG:4326") and raster.box() == (10.0, 39.5, 28.5, 50.0)
        zones = rasters.zones_of_levels(spark, LAT, rasters.level_range(5, 6), raster.box())
        got = {r.dggid: r.value_num for r in rasters.sample(geotiff.read_pixels(spark, str(tmp_path / "a.tif")), raster, zones, "k").collect()}
        want = {z.dggid: float(values[int((50 - z.lat) / 0.5), int((z.lon - 10) / 0.5)]) for z in zones.collect() if z.lat > 39.5 and z.lon < 28.5}
        assert got == want and len(want) > 10


def test_geotiff_of_the_web(spark, tmp_path):
    import numpy as np

    from cellgrid.sources import geotiff

    (tmp_path / "m.tif").write_bytes(tiff(np.arange(400, dtype="int32").reshape(20, 20), code=3857, at=(0.0, 2_000_000.0), size=100_000.0))
    raster = geotiff.raster_of(geotiff.read_headers(spark, str(tmp_path / "m.tif")))
    assert raster.crs == "EPSG:3857" and abs(raster.box()[0]) < 1e-9 and abs(raster.box()[1]) < 1e-9 and 17 < raster.box()[2] < 18
    zones = spark.createDataFrame([("a", 0.5, 0.5), ("b", 17.9, 17.5), ("c", 20.0, 1.0)], "dggid string, lon double, lat double")
    assert {r.dggid: r.value_num for r in rasters.sample(geotiff.read_pixels(spark, str(tmp_path / "m.tif")), raster, zones, "k").collect()} == {"a": 380.0, "b": 19.0}
    for bad in (b"nothing at all", tiff(np.zeros((2, 2), "uint8")).replace(b"\x03\x01\x03\x00\x01\x00\x00\x00\x01", b"\x03\x01\x03\x00\x01\x00\x00\x00\x07")):
        with pytest.raises(ValueError):
            list(geotiff.blocks_of(bad))
    assert list(rasters.level_range()) == list(range(1, 11)) and list(rasters.level_range(4)) == [4] and list(rasters.level_range(5, 3)) == [3, 4, 5]


def test_shapefile(spark, tmp_path):
    import struct

    def record(n, body):
        return struct.pack(">2i", n, len(body) // 2) + body

    outer = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    points = outer + hole
    polygon = struct.pack("<i4d2i2i", 5, 0, 0, 10, 10, 2, len(points), 0, 5) + b"".join(struct.pack("<2d", *p) for p in points)
    shp = b"\0" * 100 + record(1, struct.pack("<i2d", 1, 2.5, 3.5)) + record(2, polygon) + record(3, struct.pack("<i", 0))
    field = b"cat".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    dbf = struct.pack("<4BIHH", 3, 24, 1, 1, 3, 32 + 32 + 1, 6) + b"\0" * 20 + field + b"\x0d" + b" " + b"    7" + b" " + b"  2.5" + b" " + b"    1"
    (tmp_path / "s.shp").write_bytes(shp)
    (tmp_path / "s.dbf").write_bytes(dbf)
    f = vectors.read_shapefile(spark, str(tmp_path / "s.shp"))
    assert [(r.kind, dict(r.properties)) for r in f.orderBy("feature_no").collect()] == [("Point", {"cat": "7"}), ("MultiPolygon", {"cat": "2.5"})]
    burned = {r.dggid: r.value_num for r in vectors.burn(f.where("kind = 'MultiPolygon'"), LAT, 6, "cat").collect()}
    inside = {r.dggid for r in LAT.list_zones(spark, 6, 0, 0, 10, 10).where("not (lon between 4 and 6 and lat between 4 and 6)").collect()}
    assert set(burned) == inside and set(burned.values()) == {2.5} and vectors.burn(f.where("kind = 'Point'"), LAT, 6, "cat").first().value_num == 7.0
    # the same file in a plane of its own: a point 2.5 km east and 3.5 km north of the zone's origin on the equator
    sphere = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],UNIT["Degree",0.0174532925199433]]'
    utm = f'PROJCS["x",{sphere},PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",0.0],PARAMETER["Central_Meridian",15.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Kilometer",1000.0]]'
    web = f'PROJCS["y",{sphere},PROJECTION["Mercator_Auxiliary_Sphere"],PARAMETER["False_Easting",0.0],PARAMETER["Central_Meridian",0.0],UNIT["Kilometer",1000.0]]'
    for text, lon, lat in ((sphere, 2.5, 3.5), (utm, *rasters.TransverseMercator(15.0, false_east=0.0).back(2500.0, 3500.0)), (web, math.degrees(2500 / 6378137), math.degrees(3500 / 6378137))):
        (tmp_path / "s.prj").write_text(text)
        at = json.loads(vectors.read_shapefile(spark, str(tmp_path / "s.shp")).where("kind = 'Point'").first().coordinates)
        assert abs(at[0] - lon) < 1e-7 and abs(at[1] - lat) < 1e-7
    with pytest.raises(ValueError):
        vectors.degrees_by('PROJCS["z",PROJECTION["Lambert_Conformal_Conic"],UNIT["Meter",1.0]]')


def test_geojson_lines(spark, tmp_path):
    rows = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [k, 2.0]}, "properties": {"v": k}} for k in range(3)] + [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {}}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    assert sorted(r.value_num for r in vectors.burn(vectors.read_geojson_lines(spark, str(tmp_path / "l.json")), LAT, 7, "v").collect()) == [0.0, 1.0, 2.0]


def test_scenes_become_cells(spark):
    asset = lambda h: {"href": h, "type": "image/tiff", "roles": []}
    rows = [("s1", "c", [0.0, 0.0, 6.0, 6.0], "2024-05-01T00:00:00Z", 1.0, {"red": asset("r1"), "nir": asset("n1")}), ("s2", "c", [0.0, 0.0, 6.0, 6.0], None, 1.0, {"red": asset("r2")})]
    scenes = stac.normalise(spark.createDataFrame(rows, stac.ITEMS))
    headers = spark.createDataFrame([(p, 0.0, 6.0, 1.0, 1.0, 6, 6, -1.0) for p in ("r1", "n1", "r2")], "path string, west double, north double, pixel_width double, pixel_height double, rows int, cols int, nodata double")
    pixels = spark.createDataFrame([(p, r, c, float("nan") if (r, c) == (1, 1) else -1.0 if r == 2 else 10.0 * r + c) for p in ("r1", "n1", "r2") for r in range(6) for c in range(6)], "path string, row int, col int, value double")
    got = stac.sample_scenes(scenes, headers, pixels, LAT, 6, ["red"]).collect()
    zones = {z.dggid: (int(6 - z.lat), int(z.lon)) for z in LAT.list_zones(spark, 6, 0, 0, 6, 6).collect()}
    want = {d: 10.0 * r + c for d, (r, c) in zones.items() if r != 2 and (r, c) != (1, 1) and r < 6 and c < 6}
    for tid in (1714521600, 0):
        assert {g.dggid: g.value_num for g in got if g.tid == tid} == want and len(want) > 3
    assert {g.attr_key for g in got} == {"red"} and len(stac.sample_scenes(scenes, headers, pixels, LAT, 6, ["nir"], most=2).collect()) <= 2
    row, found = stac.build_collection(spark.createDataFrame(rows, stac.ITEMS), "mine", "c", LAT, level=5)
    assert row.first().status == "ready" and found.count() == 2 and found.where("zone_count > 0").count() == 2
    none, _ = stac.build_collection(spark.createDataFrame(rows, stac.ITEMS), "mine", "other", LAT)
    assert none.first().status == "failed" and none.first().error == "No scenes found matching criteria"


def test_demo_layers(spark):
    for layer in rasters.DEMO_LAYERS:
        rows = rasters.demo_layer(spark, LAT, layer).collect()
        assert rows and {r.attr_key for r in rows} == {layer.key}
        if layer.classes:
            assert {r.value_text for r in rows} == set(layer.classes)
        else:
            assert all(layer.low <= r.value_num <= layer.high for r in rows) and len({r.value_num for r in rows}) > 3
    with pytest.raises(ValueError):
        rasters.synthetic(spark.createDataFrame([("a", 0.0, 0.0)], "dggid string, lon double, lat double"), "k", pattern="other")


def test_polygon_cache_and_more_checks(spark):
    c = spark.createDataFrame([("C3-1-1",), ("C3-1-2",)], "dggid string")
    p = sinks.polygons(c, LAT.vertices(F.col("dggid")), LAT.level(F.col("dggid")))
    assert sinks.cache_count(p) == 2 and sinks.cache_clear(p).count() == 0 and sinks.cache_query(p, "SELECT zone_id FROM {cache} WHERE refinement = 3").count() == 2
    ring = [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1)]
    closed = spark.createDataFrame([(ring,), (ring[:2],)], "r array<struct<lon:double,lat:double>>").select(V.degrees_ring(F.col("r")).alias("c")).collect()
    assert len(closed[0].c) == 4 and closed[0].c[0] == closed[0].c[3] and abs(closed[0].c[1].lon - 5.729577951) < 1e-6 and closed[1].c is None
    assert V.check_name("  a\x07b ") == "ab" and V.check_ids(["A1"]) == ["A1"] and V.check_key("a.b-c") == "a.b-c" and V.check_range(1, None) == (1, None) and V.check_limit(5, 10) == 5
    for bad in (lambda: sinks.cache_query(p, "DROP TABLE x"), lambda: V.check_name(" "), lambda: V.check_ids([]), lambda: V.check_key("a b"), lambda: V.check_range(None, None), lambda: V.check_range(2, 1), lambda: V.check_limit(0, 10)):
        with pytest.raises(ValueError):
            bad()


def test_level_for_viewport(spark):
    for most in (10, 100, 1000):
        level = LAT.level_for_viewport(spark, 12, (-20.0, -20.0, 20.0, 20.0), most)
        n = lambda k: LAT.list_zones(spark, k, -20.0, -20.0, 20.0, 20.0).count()
        assert n(level) <= most < n(level + 1)


def test_optimised_copies_need_no_exchange(spark):
    rows = readings(spark, [(f"c{k}", 0, "k", float(k)) for k in range(100)])
    a, b = catalog.optimised(rows, "copy one"), catalog.optimised(rows.withColumnRenamed("value_num", "w"), "copy_two")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "dggid")
        assert joined.count() == 100 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        catalog.aggregated_copy(rows, rows.select("dggid", F.lit("p").alias("parent_dggid")), 2, 2)
