"""Isolines against a walk along the segments, filling against a priority flood."""

from __future__ import annotations

import heapq
import random

import pytest

from cellgrid.operators import flow, isolines

AROUND = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))


def surface(spark, seen):
    """Values, topology and places of {(q, r): value}."""
    name = lambda q, r: f"{q}.{r}"
    near = [(name(q, r), name(q + dq, r + dr)) for q, r in seen for dq, dr in AROUND if (q + dq, r + dr) in seen]
    values = spark.createDataFrame([(name(*c), v) for c, v in seen.items()], "dggid string, value_num double")
    places = spark.createDataFrame([(name(q, r), q + r / 2, r * 0.75**0.5) for q, r in seen], "dggid string, x double, y double")
    return values, spark.createDataFrame(near, "dggid string, neighbor_dggid string"), places


def plain_lines(seen, threshold):
    """Lines as lists of pairs (high cell, low cell), by following triangles one by one; closed ones from their least pair's follower."""
    follow = {}
    for q, r in seen:
        for t in (((q, r), (q + 1, r), (q, r + 1)), ((q + 1, r), (q + 1, r + 1), (q, r + 1))):
            if any(seen.get(c) is None for c in t):
                continue
            sides = [(t[k], t[(k + 1) % 3]) for k in range(3)]
            falls = [(a, b) for a, b in sides if seen[a] >= threshold > seen[b]]
            rises = [(b, a) for a, b in sides if seen[b] >= threshold > seen[a]]
            if falls:
                follow[falls[0]] = rises[0]
    # the triangle whose first cell is missing from the grid has no start here
    for q, r in {(a - 1, b) for a, b in seen} - set(seen):
        t = ((q + 1, r), (q + 1, r + 1), (q, r + 1))
        if all(seen.get(c) is not None for c in t):
            sides = [(t[k], t[(k + 1) % 3]) for k in range(3)]
            falls = [(a, b) for a, b in sides if seen[a] >= threshold > seen[b]]
            if falls:
                follow[falls[0]] = next((b, a) for a, b in sides if seen[b] >= threshold > seen[a])
    lines, left = [], dict(follow)
    for start in sorted(set(follow) - set(follow.values())):
        line = [start]
        while line[-1] in left:
            line.append(left.pop(line[-1]))
        lines.append((False, line))
    while left:
        start = next(iter(left))
        line = [start]
        while (step := left.pop(line[-1])) != start:
            line.append(step)
        least = min(range(len(line)), key=lambda k: "{}.{}>{}.{}".format(*line[k][0], *line[k][1]))
        lines.append((True, line[least + 1 :] + line[: least + 1]))
    return lines


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_isolines_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    seen = {(q, r): float(rng.randrange(12)) if seed < 3 else float(-abs(q - 9) - abs(r - 9)) for q in range(18) for r in range(18) if rng.random() > 0.04 * (seed < 3)}
    seen[next(iter(seen))] = None
    values, topo, places = surface(spark, seen)
    got = {}
    for r in isolines.isolines(values, topo, places, 5).collect():
        got.setdefault((r.level, r.line), []).append(r)
    known = [v for v in seen.values() if v is not None]
    wanted = 0
    at = lambda c: (c[0] + c[1] / 2, c[1] * 0.75**0.5)
    for level in range(1, 5):
        threshold = min(known) + (max(known) - min(known)) * level / 5
        for closed, line in plain_lines(seen, threshold):
            wanted += 1
            rows = sorted(got[level, "{}.{}>{}.{}".format(*line[-1][0], *line[-1][1])], key=lambda r: -r.remaining)
            assert [r.remaining for r in rows] == list(range(len(line) - 1, -1, -1)) and {r.closed for r in rows} == {closed}
            for r, (high, low) in zip(rows, line, strict=True):
                part = (seen[high] - threshold) / (seen[high] - seen[low])
                (x, y), (u, w) = at(high), at(low)
                assert abs(r.x - (x + (u - x) * part)) < 1e-9 and abs(r.y - (y + (w - y) * part)) < 1e-9 and abs(r.threshold - threshold) < 1e-9
    assert wanted == len(got) and wanted > 0


def test_higher_values_lie_left_of_a_ring(spark):
    seen = {(q, r): 9.0 if (q, r) == (3, 3) else 0.0 for q in range(7) for r in range(7)}
    rows = sorted(isolines.isolines(*surface(spark, seen), 2).collect(), key=lambda r: -r.remaining)
    ring = [(r.x, r.y) for r in rows]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
    assert len(ring) == 6 and all(r.closed for r in rows) and area > 0
    flat = surface(spark, {(q, 0): 1.0 for q in range(4)})
    assert isolines.isolines(*flat, 4).count() == 0
    with pytest.raises(ValueError):
        isolines.even_thresholds(flat[0], 1)


def flooded(seen, outlets):
    """Priority flood."""
    level, heap = {}, [(seen[c], c) for c in outlets]
    heapq.heapify(heap)
    while heap:
        v, (q, r) = heapq.heappop(heap)
        if (q, r) in level:
            continue
        level[q, r] = v
        for dq, dr in AROUND:
            if seen.get(c := (q + dq, r + dr)) is not None and c not in level:
                heapq.heappush(heap, (max(v, seen[c]), c))
    return level


@pytest.mark.parametrize("seed", range(4))
def test_filling_equals_a_priority_flood(spark, seed):
    rng = random.Random(seed)
    seen = {(q, r): float(rng.randrange(4 if seed == 1 else 60)) for q in range(16) for r in range(16) if seed != 2 or q != 8}
    values, topo, _ = surface(spark, seen)
    edge = {(q, r) for q, r in seen if any((q + a, r + b) not in seen for a, b in AROUND)}
    outlets = None
    if seed >= 2:  # given ones: a part of the grid without an outlet stays null
        edge = {(2, 3), (5, 11)}
        outlets = spark.createDataFrame([("2.3",), ("5.11",), ("5.11",), ("none",)], "dggid string")
    want = flooded(seen, edge)
    got = {tuple(map(int, r.dggid.split("."))): r for r in flow.fill_depressions(values, topo, outlets).collect()}
    assert set(got) == set(seen)
    for c, r in got.items():
        assert r.elevation == seen[c] and r.filled == want.get(c) and r.depth == (None if c not in want else want[c] - seen[c])
    assert seed == 2 or any(r.depth for r in got.values())


def test_basins_follow_the_steepest_descent(spark):
    rng = random.Random(9)
    seen = {(q, r): float(rng.randrange(200)) for q in range(14) for r in range(14)}
    seen[0, 0] = None
    values, topo, _ = surface(spark, seen)
    for row in flow.basins(values, topo).collect():
        at = tuple(map(int, row.dggid.split(".")))
        while True:
            near = [(seen[c], f"{c[0]}.{c[1]}", c) for a, b in AROUND if seen.get(c := (at[0] + a, at[1] + b)) is not None and seen[c] < seen[at]]
            if not near:
                break
            at = min(near)[2]
        assert row.sink == f"{at[0]}.{at[1]}"
    assert flow.basins(values.limit(0), topo).count() == 0 and flow.fill_depressions(values.limit(0), topo).count() == 0
