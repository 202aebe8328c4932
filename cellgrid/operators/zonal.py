"""Zonal statistics: one pass over the values for all statistics asked for."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import running_total

STATISTICS = {
    "sum": lambda: F.sum("value_num"), "mean": lambda: F.avg("value_num"), "min": lambda: F.min("value_num"), "max": lambda: F.max("value_num"),
    "median": None, "stddev": lambda: F.stddev("value_num"), "variance": lambda: F.variance("value_num"), "count": lambda: F.count("value_num"),
}


def masked(cells: DataFrame, mask: DataFrame | None) -> DataFrame:
    return cells if mask is None else cells.join(mask.select("dggid"), "dggid", "left_semi")


def zonal_statistics(cells: DataFrame, by: list[str], operations: list[str] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """The named statistics of value_num, grouped by the columns `by`; the grid has equal areas, so cells weigh the same."""
    unknown = set(operations or ()) - set(STATISTICS)
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    wanted = list(operations or STATISTICS)
    x = masked(cells, mask)
    plain = x.groupBy(*by).agg(F.count("*").alias("_rows"), *[STATISTICS[o]().alias(o) for o in wanted if o != "median"])
    if "median" in wanted:
        middle = percentiles(x, by, (50,)).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("p50").alias("median"))
        same = F.lit(True)
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        plain = plain.join(middle, same, "left")
    return plain.select(*by, *wanted)


def percentiles(cells: DataFrame, by: list[str], at: tuple[int, ...] = (25, 50, 75, 90), mask: DataFrame | None = None) -> DataFrame:
    """Exact interpolated percentiles. Values are counted first and ranked by running totals over ranges, so no task holds a group's values; only the two values around each percentile are picked."""
    n = masked(cells, mask).where("value_num is not null").groupBy(*by, "value_num").agg(F.count("*").alias("n"))
    x = running_total(n, "value_num", "n", "upto", tuple(by))
    total = x.groupBy(*by).agg(F.sum("n").alias("_n")).select(*[F.col(c).alias(f"_of_{c}") for c in by], "_n")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    x = x.join(total, same)
    place = lambda a: (F.col("_n") - 1) * (a / 100)
    holds = lambda rank: F.max(F.when((rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")), F.col("value_num")))
    parts = [c for a in at for c in (holds(F.floor(place(a))).alias(f"lo{a}"), holds(F.ceil(place(a))).alias(f"hi{a}"))]
    p = x.groupBy(*by).agg(F.max("_n").alias("_n"), *parts)
    between = lambda a: F.col(f"lo{a}") + (F.col(f"hi{a}") - F.col(f"lo{a}")) * (place(a) - F.floor(place(a)))
    return p.select(*by, *[between(a).alias(f"p{a}") for a in at])


def mode(cells: DataFrame, by: list[str], value: str | tuple[str, ...] = "value_num", mask: DataFrame | None = None) -> DataFrame:
    """The most frequent value (or tuple of columns), of ties the smallest; where all columns are null a row doesn't count."""
    columns = [value] if isinstance(value, str) else list(value)
    n = masked(cells, mask).dropna("all", subset=columns)
    n = n.groupBy(*by, *columns).agg(F.count("*").alias("n"))
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), *columns)).alias("m"))
    return best.select(*by, *[F.col(f"m.{c}").alias(c) for c in columns], (-F.col("m.n")).alias("n"))


def histogram(cells: DataFrame, by: list[str], bins: int = 10, closed_last: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """Equal-width bins from the least to the greatest value; the greatest opens a bin of its own unless `closed_last`."""
    if not 1 <= bins <= 50:
        raise ValueError("bins must be from 1 to 50")
    x = masked(cells, mask).where("value_num is not null")
    ends = x.groupBy(*by).agg(F.min("value_num").alias("lo"), F.max("value_num").alias("hi"))
    ends = ends.select(*by, F.when(F.col("hi") <= F.col("lo"), 0.0).otherwise(F.col("lo")).alias("lo"), F.when(F.col("hi") <= F.col("lo"), 1.0).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.floor((F.col("value_num") - F.col("lo")) / width).cast("bigint")
    k = F.least(k, F.lit(bins - 1).cast("bigint")) if closed_last else k
    n = x.join(ends, by).withColumn("bin", k).withColumn("width", width).groupBy(*by, "bin", "lo", "width").agg(F.count("*").alias("count"))
    return n.select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "count")


def zonal_by_zone(cells: DataFrame, zones: DataFrame, how: str = "MEAN", children=None, steps: int = 0) -> DataFrame:
    """A statistic of the values inside each zone: zones (dggid, zone_id) are expanded `steps` levels down to the values' level."""
    z = zones.select("dggid", "zone_id")
    for _ in range(steps):
        z = z.select(F.explode(children(F.col("dggid"))).alias("dggid"), "zone_id")
    z = z.distinct()
    f = {"MEAN": F.avg, "MAX": F.max, "MIN": F.min, "SUM": F.sum, "COUNT": F.count}[how.upper()]
    x = z.join(cells.where("value_num is not null").select("dggid", "value_num"), "dggid", "left")
    return x.groupBy("zone_id").agg(f("value_num").alias("result"), F.count("value_num").alias("count"), F.countDistinct("dggid").alias("zone_cells"))


def correlations(cells: DataFrame, keys: list[str], method: str = "pearson", mask: DataFrame | None = None) -> DataFrame:
    """Pearson's or Spearman's correlation of each pair of attributes over cells and times that have both: one pivot, one pass.

    Spearman's ranks are average ranks from running totals of the distinct values' counts, taken range by range.
    """
    wide = masked(cells, mask).where(F.col("attr_key").isin(keys)).groupBy("dggid", "tid").agg(*[F.max(F.when(F.col("attr_key") == k, F.col("value_num"))).alias(k) for k in keys])
    out = None
    for a, b in combinations(keys, 2):
        both = wide.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
        if method == "spearman":
            for c in ("x", "y"):
                n = both.groupBy(c).agg(F.count("*").alias("n"))
                both = both.join(running_total(n, c, "n", "upto").select(c, (F.col("upto") - (F.col("n") - 1) / 2).alias(f"rank_{c}")), c)
            both = both.select(F.col("rank_x").alias("x"), F.col("rank_y").alias("y"))
        elif method != "pearson":
            raise ValueError(f"unknown method {method}")
        row = both.agg(F.corr("x", "y").alias("correlation"), F.count("*").alias("cell_count")).select(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), "correlation", "cell_count")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("at least two attributes are needed")
    return out
