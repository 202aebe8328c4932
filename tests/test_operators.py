"""Operators on small tables with known answers, and laws that must hold on random ones."""

from __future__ import annotations

import math
import random
from collections import defaultdict, deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellgrid.grid import OFFSETS, HexLattice, TableGrid
from cellgrid.operators import automata, cluster, flow, neighborhood, overlay, query, reach, rollup, temporal, zonal

LAT = HexLattice()
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
CELLS = "dggid string, tid bigint, attr_key string, value_text string, value_num double, value_json string"


def cells(spark, rows):
    return spark.createDataFrame([(d, t, k, None, v, None) for d, t, k, v in rows], CELLS)


def values(spark, rows):
    return spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "dggid string, value_num double")


def plane(side):
    """Ids of a rhombus of cells, and who is next to whom."""
    at = {(q, r): f"C3-{q}-{r}" for q in range(side) for r in range(side)}
    near = {d: [at[q + a, r + b] for a, b in OFFSETS if (q + a, r + b) in at] for (q, r), d in at.items()}
    return near


def topo(spark, near):
    return spark.createDataFrame([(a, b) for a, v in near.items() for b in v], "dggid string, neighbor_dggid string")


def distances(near, starts):
    out, todo = dict.fromkeys(starts, 0), deque(starts)
    while todo:
        a = todo.popleft()
        for b in near.get(a, ()):
            if b not in out:
                out[b] = out[a] + 1
                todo.append(b)
    return out


def ids(df):
    return {r.dggid for r in df.collect()}


def test_overlay_examples(spark):
    a = cells(spark, [("H3", 0, "val", 10.0), ("H4", 0, "val", 20.0)])
    b = cells(spark, [("H3", 0, "val", 30.0), ("H5", 0, "val", 40.0)])
    assert [(r.dggid, r.value_num) for r in overlay.intersection(a, b).collect()] == [("H3", 20.0)]
    assert ids(overlay.union(a, b)) == {"H3", "H4", "H5"} and ids(overlay.difference(a, b)) == {"H4"}
    assert ids(overlay.symmetric_difference(a, b)) == {"H4", "H5"} and ids(overlay.clip(a, b)) == {"H3"}


SETS = st.sets(st.sampled_from("ABCDEFGH"), max_size=8)


@FEW
@given(SETS, SETS)
def test_set_laws(spark, x, y):
    make = lambda s: spark.createDataFrame([(v,) for v in s], "dggid string")
    a, b = make(x), make(y)
    assert ids(overlay.ids_union(a, b)) == x | y and ids(overlay.ids_intersection(a, b)) == x & y and ids(overlay.ids_difference(a, b)) == x - y


def test_queries(spark):
    c = cells(spark, [("A1", 0, "k", 1.0), ("A2", 0, "k", 2.0), ("B1", 1, "k", 3.0), ("B1", 0, "z", 9.0)])
    assert ids(query.range_query(c, "k", 2)) == {"A2", "B1"} and ids(query.range_query(c, "k", None, 1)) == {"A1"}
    with pytest.raises(ValueError):
        query.range_query(c, "k")
    assert ids(query.filter_query(c, "k", "2.0")) == {"A2"} and query.filter_query(c, "k", "two").count() == 0
    assert [r.dggid for r in query.list_cells(c, "k", "A", limit=1, offset=1).collect()] == ["A2"]
    assert (query.clamp_limit(None), query.clamp_limit(0), query.clamp_limit(10**6), query.as_number(True), query.as_number("x")) == (1, 1, 5000, None, None)
    assert query.list_cells(c, prefix="A%").count() == 0
    wide = {(r.dggid, r.tid): (r.k, r.z) for r in query.pivot_attributes(c, ["k", "z"]).collect()}
    assert wide["B1", 0] == (None, 9.0) and wide["B1", 1] == (3.0, None)


def test_rollup_counts_each_child_once(spark):
    v = values(spark, {"a": 10, "b": 10, "c": 10})
    up = spark.createDataFrame([("a", "P"), ("a", "P"), ("b", "P"), ("c", "P"), ("x", None)], "dggid string, parent_dggid string")
    r = rollup.rollup(v, up, "sum").first()
    assert (r.parent_dggid, r.value_num, r.child_count) == ("P", 30.0, 3)
    assert rollup.rollup(v, up, "sum", literal=True).first().value_num == 40.0


def test_lattice(spark):
    cell = spark.createDataFrame([("C3-4-5",), ("C4-n2-7",), ("C0-0-0",)], "dggid string")
    kids = cell.select("dggid", F.explode(LAT.children(F.col("dggid"))).alias("kid")).select("dggid", "kid", LAT.parent(F.col("kid")).alias("up"), LAT.centroid(F.col("kid")).alias("kc"), LAT.centroid(F.col("dggid")).alias("c")).collect()
    assert len(kids) == 9 and all(r.dggid == r.up for r in kids)
    middle = [r for r in kids if abs(r.kc.lon - r.c.lon) < 1e-6 and abs(r.kc.lat - r.c.lat) < 1e-6]
    assert len(middle) == 3
    zones = LAT.list_zones(spark, 4, -20, -20, 20, 20)
    back = zones.select("dggid", LAT.zone_at_point(F.col("lon"), F.col("lat"), 4).alias("again")).collect()
    assert len(back) > 20 and all(r.dggid == r.again for r in back)
    steps = zones.select("dggid", F.explode(LAT.neighbors(F.col("dggid"))).alias("n")).select(LAT.distance(F.col("dggid"), F.col("n")).alias("d")).distinct().collect()
    assert [r.d for r in steps] == [1]
    near = {(r.dggid, r.neighbor_dggid) for r in LAT.topology(zones).collect()}
    assert all((b, a) in near for a, b in near)
    assert spark.createDataFrame([("x",)], "d string").select(LAT.parent(F.col("d")).alias("p")).first().p is None
    assert LAT.level_for_viewport(spark, 6, (-20, -20, 20, 20), 60) < 6
    ring = cell.select(LAT.vertices(F.col("dggid")).alias("v")).first().v
    assert len(ring) == 7 and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(ring[0], ring[-1], strict=True))
    grid = TableGrid(LAT.topology(zones))
    assert grid.neighbors(zones).count() == len(near) and grid.parents(zones).count() <= zones.count()


@FEW
@given(st.integers(0, 10**6))
def test_reach_equals_breadth_first(spark, seed):
    rnd, near = random.Random(seed), plane(7)
    names = sorted(near)
    seeds, mask = rnd.sample(names, 3), set(rnd.sample(names, 25))
    t, s = topo(spark, near), spark.createDataFrame([(x,) for x in seeds], "dggid string")
    m = spark.createDataFrame([(x,) for x in mask], "dggid string")
    far = distances(near, seeds)
    assert ids(reach.buffer(s, t, 2)) == {a for a, d in far.items() if d <= 2} <= ids(reach.buffer(s, t, 3))
    inside = {a: [b for b in v if b in mask] for a, v in near.items()}
    assert ids(reach.propagate(s, t, m, 8)) == {a for a, d in distances(inside, seeds).items() if d <= 8}
    got = {r.dggid: (r.seed, r.distance) for r in reach.voronoi(s, t, 20).collect()}
    each = {x: distances(near, [x]) for x in seeds}
    assert got == {a: (min(seeds, key=lambda x: (each[x][a], x)), far[a]) for a in near}


@FEW
@given(st.integers(0, 10**6))
def test_shortest_path_equals_dijkstra(spark, seed):
    rnd, near = random.Random(seed), plane(5)
    names = sorted(near)
    cost = {a: rnd.randrange(1, 9) for a in rnd.sample(names, 18)}
    a, b = rnd.sample(names, 2)
    best, todo = {a: 0.0}, [a]
    while todo:
        x = min(todo, key=best.get)
        todo.remove(x)
        for y in near[x]:
            if best[x] + cost.get(y, 1) < best.get(y, math.inf):
                best[y] = best[x] + cost.get(y, 1)
                todo.append(y)
    r = reach.shortest_path(topo(spark, near), a, b, values(spark, cost), 40).first()
    assert r.found and r.total_cost == best[b] and r.path[0] == a and r.path[-1] == b and r.hops == len(r.path) - 1
    assert all(y in near[x] for x, y in zip(r.path, r.path[1:], strict=False))
    lost = reach.shortest_path(topo(spark, near), a, "nowhere", None, 5).first()
    assert not lost.found and lost.path is None


def test_long_and_empty_paths(spark, monkeypatch):
    """A path of many rounds, whose tables become one on the way; one from a cell to itself; costs that later rounds lower."""
    monkeypatch.setattr(reach, "KNOWN_TABLES", 2)
    line = {f"n{k:02}": [f"n{k + d:02}" for d in (-1, 1) if 0 <= k + d < 12] for k in range(12)}
    line["n00"], line["n11"] = ["n01", "n11"], ["n10", "n00"]
    r = reach.shortest_path(topo(spark, line), "n00", "n10", values(spark, {"n11": 50}), 40).first()
    assert (r.found, r.total_cost, r.hops) == (True, 10.0, 10) and r.path == [f"n{k:02}" for k in range(11)]
    r = reach.shortest_path(topo(spark, line), "n00", "n10", values(spark, {"n11": 50}), 9).first()
    assert (r.found, r.total_cost, r.hops, r.path) == (True, 51.0, 2, ["n00", "n11", "n10"])
    r = reach.shortest_path(topo(spark, line), "n03", "n03").first()
    assert (r.found, r.total_cost, r.hops, r.path) == (True, 0.0, 0, ["n03"])


@FEW
@given(st.integers(0, 10**6))
def test_flow_gathers_everything(spark, seed):
    rnd, near = random.Random(seed), plane(6)
    e = {a: rnd.randrange(12) for a in near}
    v, t = values(spark, e), topo(spark, near)
    d = {r.dggid: r.target for r in flow.flow_direction(v, t).collect()}
    assert d == {a: min(lower, key=lambda b: (e[b], b)) for a in near if (lower := [b for b in near[a] if e[b] < e[a]])}
    want = defaultdict(int)
    for a in near:
        x = a
        want[x] += 1
        while x in d:
            x = d[x]
            want[x] += 1
    got = {r.dggid: r.flow for r in flow.flow_accumulation(v, flow.flow_direction(v, t)).collect()}
    assert got == dict(want) and sum(got[a] for a in near if a not in d) == len(near)


def scan(values_, near, sd, min_points, threshold):
    """Clusters by one pass over the cells in id order, as a sequential program would find them."""
    limit = sd * threshold if sd else 1.0
    sim = {a: [b for b in near[a] if b in values_ and abs(values_[a] - values_[b]) <= limit] for a in values_}
    label, k = {}, 0
    for a in sorted(values_):
        if a in label:
            continue
        if len(sim[a]) < min_points:
            label[a] = -1
            continue
        label[a], todo = k, list(sim[a])
        while todo:
            b = todo.pop()
            if b not in label:
                label[b] = k
                if len(sim[b]) >= min_points:
                    todo += sim[b]
        k += 1
    return label


@FEW
@given(st.integers(0, 10**6))
def test_dbscan_equals_scan(spark, seed):
    rnd, near = random.Random(seed), plane(6)
    v = {a: float(rnd.randrange(6)) for a in near if rnd.random() < 0.9}
    m = sum(v.values()) / len(v)
    sd = math.sqrt(sum((x - m) ** 2 for x in v.values()) / len(v))
    got = {r.dggid: r.cluster_id for r in cluster.dbscan(values(spark, v), topo(spark, near), 3, 0.5).collect()}
    assert got == scan(v, near, sd, 3, 0.5)


def test_automata(spark):
    near = plane(5)
    t = topo(spark, near)
    state = spark.createDataFrame([(a, "burning" if a == "C3-2-2" else "unburned") for a in near], "dggid string, state string")
    far = distances(near, ["C3-2-2"])
    got = {r.dggid: r.state for r in automata.run(state, t, 2).collect()}
    assert got == {a: "burned" if d < 2 else "burning" if d == 2 else "unburned" for a, d in far.items()}
    done = {r.state for r in automata.run(state, t, 50, until_stable=True).collect()}
    assert done == {"burned"}
    wall = spark.createDataFrame([("C3-2-2",)], "dggid string")
    assert {r.dggid for r in automata.run(state, t, 3, mask=wall).where("state = 'burned'").collect()} == {"C3-2-2"}
    life = spark.createDataFrame([(a, "alive" if a in ("C3-1-1", "C3-1-2", "C3-2-1") else "dead") for a in near], "dggid string, state string")
    assert {r.state for r in automata.step(life, t, "game_of_life").where("dggid = 'C3-1-1'").collect()} == {"alive"}


def test_zonal_edges(spark):
    v = cells(spark, [("a", 0, "k", 5.0), ("b", 0, "k", 5.0), ("c", 0, "k", None)])
    h = zonal.histogram(v, ["attr_key"], 4).collect()
    assert len(h) == 1 and h[0]["count"] == 2 and h[0].bin == 20
    s = zonal.zonal_statistics(v, ["attr_key"]).first()
    assert (s["sum"], s["count"], s["stddev"]) == (10.0, 2, 0.0)
    with pytest.raises(ValueError):
        zonal.zonal_statistics(v, ["attr_key"], ["nothing"])


def test_neighbourhood_edges(spark):
    near = plane(3)
    flat, t = values(spark, dict.fromkeys(near, 4)), topo(spark, near)
    assert neighborhood.morans_i(flat, t).first().morans_i == 0.0 and neighborhood.lisa(flat, t).count() == 0
    assert {r.gi_z for r in neighborhood.hotspots(flat, t).collect()} == {0.0}
    none = flat.limit(0)
    assert neighborhood.morans_i(none, t).first().n == 0 and reach.buffer(none, t, 2).count() == 0
    kinds = {r.dggid: r.change_type for r in neighborhood.change(values(spark, {"a": 1, "b": 2, "c": 3}), values(spark, {"b": 5, "c": 3, "d": 1}), keep_stable=True).collect()}
    assert kinds == {"a": "disappeared", "b": "gain", "c": "stable", "d": "appeared"}


def test_time(spark):
    c = cells(spark, [("a", t, "k", float(t * t)) for t in range(5)])
    assert temporal.snapshot(c, 3).first().value_num == 9.0
    assert temporal.temporal_aggregate(c, 1, 3, "first").first().value_num == 1.0 and temporal.temporal_aggregate(c, 1, 3, "last").first().value_num == 9.0
    with pytest.raises(ValueError):
        temporal.temporal_aggregate(c, 1, 3, "middle")
    assert [r.value_num for r in temporal.timeseries(c, "a", "k", 2).collect()] == [4.0, 9.0, 16.0]
    assert temporal.hierarchy(spark).count() == 10


@FEW
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=1, max_size=40), st.integers(1, 4))
def test_hull_holds_all_points(spark, points, parts):
    from cellgrid.operators import geometry

    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in points], "g string, lon double, lat double").repartition(parts)
    got = [(r.lon, r.lat) for r in geometry.convex_hull(df, "g").orderBy("corner").collect()]
    assert set(got) <= {(float(x), float(y)) for x, y in points} and got == geometry.hull([(float(x), float(y)) for x, y in points])
    if len(got) > 2:
        for a, b in zip(got, got[1:] + got[:1], strict=True):
            assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9 for x, y in points)


def test_line_of_sight(spark):
    e = {a: 0.0 for a in plane(7)}
    e["C3-3-3"] = 50.0
    got = {r.dggid: r.visible for r in reach.line_of_sight(values(spark, e), LAT, "C3-1-3", 1.8, 5).collect()}
    assert got["C3-2-3"] and got["C3-3-3"] and not got["C3-4-3"] and not got["C3-5-3"]


@FEW
@given(st.lists(st.integers(-30, 30), min_size=0, max_size=40, unique=True), st.integers(0, 99))
def test_running_total(spark, keys, seed):
    from cellgrid.session import running_total

    rnd = random.Random(seed)
    rows = [(k, rnd.randrange(5)) for k in keys]
    got = {r.k: r.t for r in running_total(spark.createDataFrame(rows, "k int, v int"), "k", "v", "t").collect()}
    want, total = {}, 0
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want


def test_automata_stop_at_a_share(spark):
    """A line of ten cells burns from one end: one cell catches fire and one burns out in each step, so eight of ten keep their state."""
    from cellgrid.operators import automata

    topo = spark.createDataFrame([(str(a), str(b)) for a in range(10) for b in (a - 1, a + 1) if 0 <= b < 10], "dggid string, neighbor_dggid string")
    state = spark.createDataFrame([(str(k), "burning" if k == 0 else "unburned") for k in range(10)], "dggid string, state string")
    count = lambda **how: automata.run(state, topo, 50, **how).where("state != 'unburned'").count()
    assert count(stop="threshold:0.8") == 2 and count(stop="threshold:0") == 2
    assert count(stop="threshold:0.9") == 10 and count(stop="no_changes") == count(until_stable=True) == 10
    for bad in ("threshold:2", "threshold:x", "never", "threshold", "no_changes:1"):
        with pytest.raises(ValueError):
            automata.run(state, topo, 1, stop=bad)
