"""Rank tests against all pairs, decomposition against plain loops."""

from __future__ import annotations

import itertools
import math
import random
import statistics

import numpy as np
import pytest

from cellgrid.operators import series


def cells(spark, by_name):
    rows = [(name, "k", t, v) for name, points in by_name.items() for t, v in points]
    return spark.createDataFrame(rows, "dggid string, attr_key string, tid bigint, value_num double")


def sign(x):
    return (x > 0) - (x < 0)


def test_mann_kendall_equals_all_pairs(spark):
    rng = random.Random(4)
    named = {f"c{k}": [(t, float(rng.randrange(8)) + t * rng.choice([0, 0.1, -0.2])) for t in sorted(rng.sample(range(-20, 200), n))] for k, n in enumerate((2, 3, 10, 33, 70, 150))}
    named |= {"flat": [(t, 2.0) for t in range(9)], "one": [(1, 1.0)], "rise": [(t, t * 3.0) for t in range(40)]}
    got = {r.dggid: r for r in series.mann_kendall(cells(spark, {**named, "gap": [(1, None), (2, float("nan"))]})).collect()}
    assert set(got) == set(named) - {"one"}
    for name in got:
        p, r = named[name], got[name]
        n, s = len(p), sum(sign(b[1] - a[1]) for a, b in itertools.combinations(p, 2))
        ties = [len(list(g)) for _, g in itertools.groupby(sorted(v for _, v in p))]
        variance = (n * (n - 1) * (2 * n + 5) - sum(k * (k - 1) * (2 * k + 5) for k in ties)) / 18
        assert (r.points, r.s) == (n, s) and abs(r.variance - variance) < 1e-9 and abs(r.tau - 2 * s / (n * (n - 1))) < 1e-12
        assert abs(r.slope - statistics.median((b[1] - a[1]) / (b[0] - a[0]) for a, b in itertools.combinations(p, 2))) < 1e-12
        assert abs(r.z - ((s - sign(s)) / math.sqrt(variance) if variance else 0)) < 1e-12
    assert got["rise"].trend == "up" and got["flat"].trend == "none" and got["flat"].z == 0


@pytest.mark.parametrize("n", [513, 700, 701])
def test_slopes_by_rank_equal_all_slopes(n):
    rng = np.random.default_rng(n)
    t = np.sort(rng.choice(5000, n, replace=False)).astype(float)
    for v in (rng.normal(size=n) + t * 0.01, rng.integers(0, 4, n).astype(float), t * 2.0):
        i, j = np.triu_indices(n, 1)
        assert abs(series.median_slope(t, v) - np.median((v[j] - v[i]) / (t[j] - t[i]))) < 1e-10
        assert series.concordance(v) == int(np.sign(v[j] - v[i]).sum())


def plain_loess(xs, ys, ws, at, q):
    """One local line, point by point."""
    far = sorted(abs(x - at) for x in xs)
    h = far[min(q, len(xs)) - 1] * max(1.0, q / len(xs))
    g = [(1 - (abs(x - at) / max(h, 1e-12)) ** 3) ** 3 * w if abs(x - at) < max(h, 1e-12) else 0.0 for x, w in zip(xs, ws, strict=True)]
    if sum(g) <= 0:
        g = [1.0 if abs(x - at) <= h else 0.0 for x in xs]
    mx, my = sum(a * x for a, x in zip(g, xs, strict=True)) / sum(g), sum(a * y for a, y in zip(g, ys, strict=True)) / sum(g)
    sxx = sum(a * (x - mx) ** 2 for a, x in zip(g, xs, strict=True))
    if sxx <= 1e-9 * sum(g):
        return my
    return my + sum(a * (x - mx) * (y - my) for a, x, y in zip(g, xs, ys, strict=True)) / sxx * (at - mx)


def plain_stl(t, v, period, seasonal, inner, outer):
    first, n = t[0], t[-1] - t[0] + 1
    own, w = [x - first for x in t], [1.0] * len(t)
    trend, season = [0.0] * n, [0.0] * n
    odd = lambda q: int(q) if int(q) % 2 else int(q) + 1
    for rnd in range(outer + 1):
        for _ in range(inner):
            cycle = [0.0] * (n + 2 * period)
            for k in range(period):
                mine = [i for i, x in enumerate(own) if x % period == k]
                for at in range(k, n + 2 * period, period) if mine else ():
                    cycle[at] = plain_loess([own[i] // period for i in mine], [v[i] - trend[own[i]] for i in mine], [w[i] for i in mine], at // period - 1, seasonal)
            low = cycle
            for m in (period, period, 3):
                low = [sum(low[i : i + m]) / m for i in range(len(low) - m + 1)]
            smooth = [plain_loess(range(n), low, [1.0] * n, i, odd(period)) for i in range(n)]
            season = [cycle[period + i] - smooth[i] for i in range(n)]
            trend = [plain_loess(own, [y - season[x] for x, y in zip(own, v, strict=True)], w, i, odd(math.ceil(1.5 * period / (1 - 1.5 / seasonal)))) for i in range(n)]
        rest = [abs(y - season[x] - trend[x]) for x, y in zip(own, v, strict=True)]
        h = 6 * statistics.median(rest)
        w = [(1 - min(r / h, 1) ** 2) ** 2 if h > 1e-12 * max(1.0, max(map(abs, v))) else 1.0 for r in rest]
    return [trend[x] for x in own], [season[x] for x in own]


def test_decomposition_equals_plain_loops(spark):
    rng = random.Random(8)
    named = {}
    for name, period, gaps in (("whole", 6, 0.0), ("gaps", 6, 0.25), ("short", 6, 0.0)):
        n = 12 if name == "short" else 48
        named[name] = [(100 + t, 3 + t * 0.1 + 2 * math.sin(2 * math.pi * t / period) + rng.gauss(0, 0.2) + (9 if t == 20 else 0)) for t in range(n) if t in (0, n - 1) or rng.random() >= gaps]
    got = {}
    for r in series.decompose(cells(spark, {**named, "little": [(0, 1.0), (1, 2.0)], "brief": [(t, 1.0) for t in range(11)]}), 6, 7, 2, 3).collect():
        got.setdefault(r.dggid, []).append(r)
    assert set(got) == set(named)
    for name, points in named.items():
        rows = sorted(got[name], key=lambda r: r.tid)
        trend, season = plain_stl([t for t, _ in points], [v for _, v in points], 6, 7, 2, 3)
        assert [r.tid for r in rows] == [t for t, _ in points]
        for r, a, b, (_, v) in zip(rows, trend, season, points, strict=True):
            assert abs(r.trend - a) < 1e-6 and abs(r.seasonal - b) < 1e-6 and abs(r.trend + r.seasonal + r.residual - v) < 1e-9


def test_decomposition_finds_the_season(spark):
    points = [(t, 5 + 0.02 * t + [3, -1, 0, -2][t % 4]) for t in range(60)]
    rows = sorted(series.decompose(cells(spark, {"a": points}), 4).collect(), key=lambda r: r.tid)
    assert all(abs(r.seasonal - [3, -1, 0, -2][r.tid % 4]) < 0.05 and abs(r.residual) < 0.05 for r in rows)
    for bad in ((1, 7), (4, 2)):
        with pytest.raises(ValueError):
            series.decompose(cells(spark, {"a": points}), *bad)


def test_many_series_cost_as_many_fits_as_one(monkeypatch):
    rng, own, fits, fit = np.random.default_rng(2), np.array([0, 1, 2, 4, 5, 6, 9]), [], series.loess
    monkeypatch.setattr(series, "loess", lambda *args: fits.append(1) or fit(*args))
    v = rng.normal(100, 30, (500, 7))
    trend, season = series.decomposed(own, v, 3)
    many = len(fits)
    for k in range(0, 500, 25):
        a, b = series.decomposed(own, v[k : k + 1], 3)
        assert np.allclose(trend[k], a[0], atol=1e-9) and np.allclose(season[k], b[0], atol=1e-9)
    assert trend.shape == season.shape == (500, 7) and len(fits) == 21 * many


def test_decomposition_of_series_with_all_kinds_of_gaps(spark):
    """Series that begin at different times, some with their points at the same times, some not; single points and times without a value between them."""
    rng, named = random.Random(5), {}
    for k in range(60):
        times = [t for t in range(9) if rng.random() < 0.8] if k % 3 else list(range(7))
        named[f"s{k}"] = [(1992 + k % 4 + t, rng.gauss(100, 40)) for t in times]
    want = {k: p for k, p in named.items() if len(p) >= 3 and p[-1][0] - p[0][0] >= 5}
    got = {}
    for r in series.decompose(cells(spark, named), 3).collect():
        got.setdefault(r.dggid, {})[r.tid] = r
    assert got.keys() == want.keys() and 40 < len(got)
    for name, points in want.items():
        trend, season = plain_stl([t for t, _ in points], [v for _, v in points], 3, 7, 2, 5)
        assert got[name].keys() == {t for t, _ in points}
        for (t, v), a, b in zip(points, trend, season, strict=True):
            r = got[name][t]
            assert r.value_num == v and abs(r.trend - a) < 1e-6 and abs(r.seasonal - b) < 1e-6 and abs(r.residual - (v - a - b)) < 1e-6
