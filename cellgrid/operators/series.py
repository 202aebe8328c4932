"""Series of values over time, one for each cell and attribute: rank tests of a trend, and decomposition into trend, season and rest.

A series is gathered by one shuffle and worked on as an array, many series a batch; it is as long as a cell has times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Series up to this length have all their slopes written out; longer ones are searched by rank.
ALL_PAIRS = 512


def _series(cells: DataFrame) -> DataFrame:
    """(dggid, attr_key, points) of every series: its times and values, in time order; of several values at a time the mean counts."""
    x = cells.where("value_num is not null AND NOT isnan(value_num)").groupBy("dggid", "attr_key", "tid").agg(F.avg("value_num").alias("v"))
    return x.groupBy("dggid", "attr_key").agg(F.array_sort(F.collect_list(F.struct("tid", "v"))).alias("points"))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each series of a batch begins and the last one ends, and the times and values of all."""
    points = b.column(2)
    at, flat = points.offsets.to_numpy(), points.flatten()
    return at - at[0], flat.field("tid").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False)


def _by_series(cells: DataFrame, schema: str, work: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """(dggid, attr_key, ...) of what `work` makes of each series' times and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, t, v = _flat(b)
            found = [work(t[a:z], v[a:z]) for a, z in zip(at, at[1:], strict=False)]
            if found:
                series = pa.array(np.repeat(np.arange(b.num_rows), [len(next(iter(x.values()))) for x in found]))
                columns = {c: pa.array(np.concatenate([x[c] for x in found])) for c in found[0]}
                yield pa.RecordBatch.from_arrays([b.column(0).take(series), b.column(1).take(series), *columns.values()], ["dggid", "attr_key", *columns])

    return _series(cells).mapInArrow(run, f"dggid string, attr_key string, {schema}")


def concordance(v: np.ndarray) -> int:
    """How many pairs rise minus how many fall, by merging sorted halves."""
    def count(v: np.ndarray) -> tuple[int, np.ndarray]:
        if len(v) <= 32:
            return int(np.triu(np.sign(v[None, :] - v[:, None])).sum()), np.sort(v)
        (a, left), (b, right) = count(v[: len(v) // 2]), count(v[len(v) // 2 :])
        below, upto = np.searchsorted(left, right, "left"), np.searchsorted(left, right, "right")
        return a + b + int(below.sum() - (len(left) - upto).sum()), np.sort(np.concatenate([left, right]), kind="stable")

    return count(v)[0]


def median_slope(t: np.ndarray, v: np.ndarray) -> float:
    """The median of the slopes of all pairs (the mean of the middle two of an even number)."""
    n = len(t)
    if n <= ALL_PAIRS:
        i, j = np.triu_indices(n, 1)
        return float(np.median((v[j] - v[i]) / (t[j] - t[i])))
    pairs = n * (n - 1) // 2
    x = t - t[0]

    def at_most(m: float) -> int:
        u = v - m * x  # a pair's slope is at most m where u doesn't rise
        _, number = np.unique(u, return_inverse=True)
        ties = int((np.bincount(number).astype(np.int64) ** 2).sum() - n) // 2
        return (pairs - concordance(u) + ties) // 2

    def ranked(k: int) -> float:
        steps = np.diff(v) / np.diff(t)
        low, high = float(steps.min()), float(steps.max())  # every slope is a mean of these
        while high - low > 1e-13 * max(abs(low), abs(high), 1e-300):
            middle = (low + high) / 2
            if middle in (low, high):
                break
            low, high = (low, middle) if at_most(middle) >= k else (middle, high)
        return high

    return ranked((pairs + 1) // 2) if pairs % 2 else (ranked(pairs // 2) + ranked(pairs // 2 + 1)) / 2


def mann_kendall(cells: DataFrame, critical: float = 1.96) -> DataFrame:
    """(dggid, attr_key, points, s, variance, z, tau, slope, trend) of every series of two points or more.

    s is the number of rising pairs minus that of falling ones, its variance allows for ties, z is continuity-corrected (0 without
    variance); slope is the median slope of all pairs (Theil and Sen); trend is `up` or `down` where z passes `critical`, else `none`.
    """
    def work(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        n = len(v)
        if n < 2:
            return {c: np.empty(0, np.int64 if c in ("points", "s") else float) for c in ("points", "s", "variance", "slope")}
        ties = np.unique(v, return_counts=True)[1].astype(object)
        variance = (n * (n - 1) * (2 * n + 5) - sum(k * (k - 1) * (2 * k + 5) for k in ties)) / 18
        return {"points": np.array([n]), "s": np.array([concordance(v)]), "variance": np.array([float(variance)]), "slope": np.array([median_slope(t.astype(float), v)])}

    x = _by_series(cells, "points bigint, s bigint, variance double, slope double", work)
    z = F.when(F.col("variance") > 0, (F.col("s") - F.signum("s")) / F.sqrt("variance")).otherwise(0.0)
    x = x.withColumn("z", z).withColumn("tau", 2 * F.col("s") / (F.col("points") * (F.col("points") - 1)))
    label = F.when(F.col("z") > critical, "up").when(F.col("z") < -critical, "down").otherwise("none")
    return x.select("dggid", "attr_key", "points", "s", "variance", "z", "tau", "slope", label.alias("trend"))


def loess(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Locally weighted lines through (x, y), evaluated at other places: tricube weights over the `q` nearest points, times `w`.

    With fewer points than `q`, the window widens in proportion. Without spread or weight, the mean counts. y and w have a row for each
    of many series with the same points; their sums are products with the one matrix of tricube weights.
    """
    out, n = np.empty((len(y), len(at))), len(x)
    for k in range(0, len(at), max(1, (1 << 21) // max(1, n))):
        here = at[k : k + max(1, (1 << 21) // max(1, n))]
        d = x[None, :] - here[:, None]
        far = np.abs(d)
        h = np.partition(far, min(q, n) - 1, axis=1)[:, min(q, n) - 1] * max(1.0, q / n)
        u = far / np.maximum(h, 1e-12)[:, None]
        g = np.where(u < 1, (1 - np.minimum(u, 1) ** 3) ** 3, 0.0)
        s0, s1, s2, t0, t1 = _moments(g, d, w, y)
        none = s0 <= 0
        if none.any():
            s0, s1, s2, t0, t1 = (np.where(none, b, a) for a, b in zip((s0, s1, s2, t0, t1), _moments((far <= h[:, None]) * 1.0, d, np.ones_like(w), y), strict=True))
        spread = s0 * s2 - s1 * s1
        line = spread > 1e-9 * s0 * s0
        out[:, k : k + len(here)] = np.where(line, (s2 * t0 - s1 * t1) / np.where(line, spread, 1.0), t0 / s0)
    return out


def _moments(g: np.ndarray, d: np.ndarray, w: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(series, places): sums of the weights g * w over the points, of those times d and d * d, and of those times y and d * y."""
    gd, wy = g * d, w * y
    return w @ g.T, w @ gd.T, w @ (gd * d).T, wy @ g.T, wy @ gd.T


def _moving(v: np.ndarray, n: int) -> np.ndarray:
    sums = np.cumsum(np.concatenate([np.zeros((len(v), 1)), v], axis=1), axis=1)
    return (sums[:, n:] - sums[:, :-n]) / n


def decomposed(own: np.ndarray, v: np.ndarray, period: int, seasonal: int = 7, inner: int = 2, outer: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season of series (a row of v each) by loess (STL); the rest is what they leave. `own` are their times since the first, whole numbers with gaps.

    Smoothing uses the points that are there and is evaluated at every time between the first and the last one. A season that has no
    point takes 0. Points far from the fit count less in each of the `outer` rounds.
    """
    n = int(own[-1]) + 1
    every = np.arange(n, dtype=float)
    x, w, season, trend = own.astype(float), np.ones(v.shape), np.zeros((len(v), n)), np.zeros((len(v), n))
    odd = lambda q: int(q) + 1 - int(q) % 2
    low_q, trend_q = odd(period), odd(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    for rnd in range(outer + 1):
        for _ in range(inner):
            loose = v - trend[:, own]
            cycle = np.zeros((len(v), n + 2 * period))  # one period more at each end
            for k in range(period):
                mine = own % period == k
                places = np.arange(k, n + 2 * period, period)
                if mine.any():
                    cycle[:, places] = loess((x[mine] - k) / period, loose[:, mine], w[:, mine], (places - k) / period - 1.0, seasonal)
            low = _moving(_moving(_moving(cycle, period), period), 3)
            season = cycle[:, period : period + n] - loess(every, low, np.ones(low.shape), every, low_q)
            trend = loess(x, v - season[:, own], w, every, trend_q)
        if rnd < outer:
            rest = np.abs(v - season[:, own] - trend[:, own])
            h = 6 * np.median(rest, axis=1, keepdims=True)
            loose = h > 1e-12 * np.maximum(1.0, np.abs(v).max(axis=1, keepdims=True))
            w = np.where(loose, (1 - np.minimum(rest / np.where(loose, h, 1.0), 1) ** 2) ** 2, 1.0)
    return trend[:, own], season[:, own]


#: Times of series that are decomposed together.
MOST_TIMES = 1 << 18


def decompose(cells: DataFrame, period: int, seasonal: int = 7, inner: int = 2, outer: int = 5) -> DataFrame:
    """(dggid, attr_key, tid, value_num, trend, seasonal, residual), which add up, for series that span two periods at least; others have no rows.

    Series of a batch that have their points at the same times since the first one are worked on together.
    """
    if period < 2 or seasonal < 3:
        raise ValueError("a period has two times at least, a seasonal window three")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            at, t, v = _flat(b)
            first, size = at[:-1], np.diff(at)
            own = (t - np.repeat(t[first], size)).astype(np.int64)
            long = (size >= 3) & (own[at[1:] - 1] + 1 >= 2 * period)
            alike: dict[bytes, list[int]] = {}
            for k in np.flatnonzero(long).tolist():
                alike.setdefault(own[at[k] : at[k + 1]].tobytes(), []).append(k)
            trend, season = np.zeros(len(t)), np.zeros(len(t))
            for times, which in alike.items():
                x = np.frombuffer(times, np.int64)
                step = max(1, MOST_TIMES // (int(x[-1]) + 1))
                for k in range(0, len(which), step):
                    rows = first[which[k : k + step]][:, None] + np.arange(len(x))
                    trend[rows], season[rows] = decomposed(x, v[rows], period, seasonal, inner, outer)
            keep = np.repeat(long, size)
            series, t, v, trend, season = (c[keep] for c in (np.repeat(np.arange(b.num_rows), size), t, v, trend, season))
            columns = [b.column(0).take(pa.array(series)), b.column(1).take(pa.array(series)), *map(pa.array, (t, v, trend, season, v - trend - season))]
            yield pa.RecordBatch.from_arrays(columns, ["dggid", "attr_key", "tid", "value_num", "trend", "seasonal", "residual"])

    schema = "dggid string, attr_key string, tid bigint, value_num double, trend double, seasonal double, residual double"
    return _series(cells.where("tid is not null")).mapInArrow(run, schema)
