"""Covers against every cell of a level, and how their size grows."""

from __future__ import annotations

import json
import math
import random

import pytest

from cellgrid.grid import HexLattice
from cellgrid.sources import cover, vectors

GRID = HexLattice()


def star(rng, x, y, far, corners):
    """A ring around a point, each corner at its own distance."""
    return [[x + math.cos(a) * (d := far * rng.uniform(0.3, 1)), y + math.sin(a) * d * 0.7] for a in (2 * math.pi * k / corners for k in range(corners))]


def inside(x, y, rings):
    """Parity of crossings, ring by ring."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def shapes():
    rng, out = random.Random(6), []
    for k in range(6):
        x, y, far = rng.uniform(-120, 120), rng.uniform(-60, 60), rng.choice([2.0, 9.0, 25.0])
        rings = [star(rng, x, y, far, rng.randrange(3, 40))]
        rings += [star(rng, x, y, far * 0.25, 5)] if k % 2 else []
        out.append((k, rings))
    out.append((6, [[[-170, -89], [170, -89], [170, 89], [-170, 89]]]))
    out.append((7, [[[0.001, 0.001], [0.002, 0.001], [0.002, 0.002]]]))
    return out


@pytest.fixture(scope="module")
def polygons(spark):
    rows = [(k, [[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in rings]) for k, rings in shapes()]
    return spark.createDataFrame(rows, "k int, rings array<array<struct<lon:double,lat:double>>>").repartition(8).cache()


@pytest.mark.parametrize("level", [0, 1, 4, 6])
def test_polygons_equal_every_cell(spark, polygons, level):
    zones = GRID.list_zones(spark, level, -180, -90, 180, 90).collect()
    found = cover.cover_polygons(polygons, GRID, level)
    got = {(r.k, r.dggid) for r in cover.expanded(found, GRID, level).collect()}
    assert got == {(k, z.dggid) for k, rings in shapes() for z in zones if inside(z.lon, z.lat, rings)}
    counts = {r.k: r.n for r in found.groupBy("k").agg(cover.cells_of(level).alias("n")).collect()}
    assert counts == {k: n for k, _ in shapes() if (n := sum(1 for x, _ in got if x == k))}


def test_boxes_equal_every_cell(spark):
    boxes = [(0, -10.0, -5.5, 20.25, 33.0), (1, 100.0, 60.0, 170.0, 90.0), (2, 5.0, 5.0, 5.01, 5.01), (3, 7.0, 0.0, 6.0, 1.0), (4, -180.0, -90.0, 180.0, 90.0)]
    p = spark.createDataFrame(boxes, "k int, w double, s double, e double, n double")
    for level in (2, 5):
        zones = GRID.list_zones(spark, level, -180, -90, 180, 90).collect()
        got = {(r.k, r.dggid) for r in vectors.cells_in_boxes(p, GRID, level).collect()}
        assert got == {(k, z.dggid) for k, w, s, e, n in boxes for z in zones if w <= z.lon <= e and s <= z.lat <= n and abs(z.lat) < 90}


def test_rows_grow_with_the_edge(spark):
    """Two levels more: nine times the cells, about three times the rows; a fine cover of a large area stays small."""
    p = spark.createDataFrame([(1, -40.0, -30.0, 41.0, 33.0)], "k int, w double, s double, e double, n double")
    rows = {k: cover.cover_boxes(p, GRID, k).count() for k in (6, 8, 10)}
    cells = {k: cover.cover_boxes(p, GRID, k).agg(cover.cells_of(k)).first()[0] for k in (6, 8, 10)}
    for a, b in ((6, 8), (8, 10)):
        assert 8.5 < cells[b] / cells[a] < 9.5 and rows[b] / rows[a] < 4.2
    assert rows[10] * 4 < cells[10]


def test_burn_keeps_holes_and_the_last_feature(spark):
    f = [(k, "Polygon", json.dumps(rings), {"v": str(k)}) for k, rings in shapes()[:6]] + [(9, "MultiPolygon", json.dumps([shapes()[0][1], shapes()[1][1]]), {"v": "9"}), (10, "Point", "[3.5, 4.5]", {"v": "10"})]
    features = spark.createDataFrame(f, "feature_no bigint, kind string, coordinates string, properties map<string,string>")
    zones, want = GRID.list_zones(spark, 5, -180, -90, 180, 90).collect(), {}
    for k, rings in [*shapes()[:6], (9, shapes()[0][1]), (9, shapes()[1][1])]:
        want |= {z.dggid: float(k) for z in zones if inside(z.lon, z.lat, rings)}
    got = {r.dggid: r.value_num for r in vectors.burn(features, GRID, 5, "v").collect()}
    point = set(got) - set(want)
    assert len(point) <= 1 and {c: v for c, v in got.items() if c not in point and v != 10} == {c: v for c, v in want.items() if got[c] != 10}
