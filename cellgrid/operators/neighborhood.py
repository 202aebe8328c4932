"""Neighbourhood operators: a value joined with its neighbours' values, then aggregated.

`values` is (dggid, value_num), one row per cell; `topo` is (dggid, neighbor_dggid). Both joins are on ids, so that tables
bucketed by dggid need no exchange on that side, and Spark broadcasts a topology only where it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reach import hops


def pairs(values: DataFrame, topo: DataFrame) -> DataFrame:
    """(dggid, v, neighbor, v_n) for each neighbour that has a value; a topology with repeated rows counts once."""
    v = values.where("value_num is not null").select("dggid", F.col("value_num").alias("v"))
    t = topo.select("dggid", F.col("neighbor_dggid").alias("neighbor")).distinct()
    n = v.select(F.col("dggid").alias("neighbor"), F.col("v").alias("v_n"))
    return v.join(t, "dggid").join(n, "neighbor").select("dggid", "v", "neighbor", "v_n")


def _with_stats(x: DataFrame, values: DataFrame) -> DataFrame:
    """x beside the mean, population deviation and number of all values: one row, broadcast."""
    s = values.where("value_num is not null").agg(F.avg("value_num").alias("m"), F.stddev_pop("value_num").alias("sd"), F.count("value_num").alias("n"))
    return x.crossJoin(F.broadcast(s))


def _significance(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a >= 2.58, "p<0.01").when(a >= 1.96, "p<0.05").when(a >= 1.65, "p<0.10").otherwise("not significant")


def morans_i(values: DataFrame, topo: DataFrame) -> DataFrame:
    """Global autocorrelation: n, w, morans_i, expected_i, z, significance and interpretation, in one row."""
    d = _with_stats(pairs(values, topo), values)
    cross = d.agg(F.count("*").alias("w"), F.sum((F.col("v") - F.col("m")) * (F.col("v_n") - F.col("m"))).alias("c"))
    own = _with_stats(values.where("value_num is not null"), values).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("value_num") - F.col("m"), 2)).alias("ss"))
    x = own.crossJoin(F.broadcast(cross))
    i = F.when((F.col("w") > 0) & (F.col("ss") > 0), F.col("n") / F.col("w") * F.col("c") / F.col("ss")).otherwise(0.0)
    x = x.withColumn("i", i).withColumn("e", F.when(F.col("n") > 1, F.lit(-1.0) / (F.col("n") - 1)).otherwise(0.0))
    x = x.withColumn("zz", F.when((F.col("w") > 0) & (F.col("ss") > 0), (F.col("i") - F.col("e")) * F.sqrt("n")).otherwise(0.0))
    say = F.when(F.col("i") > F.col("e") + 0.1, "clustered").when(F.col("i") < F.col("e") - 0.1, "dispersed").otherwise("random")
    return x.select("n", "w", F.round("i", 6).alias("morans_i"), F.round("e", 6).alias("expected_i"), F.round("zz", 4).alias("z"), _significance(F.col("zz")).alias("significance"), say.alias("interpretation"))


def gearys_c(values: DataFrame, topo: DataFrame) -> DataFrame:
    """Geary's C: below 1 for similar neighbours, above 1 for different ones."""
    cross = pairs(values, topo).agg(F.count("*").alias("w"), F.sum(F.pow(F.col("v") - F.col("v_n"), 2)).alias("c"))
    own = _with_stats(values.where("value_num is not null"), values).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("value_num") - F.col("m"), 2)).alias("ss"))
    c = F.when((F.col("w") > 0) & (F.col("ss") > 0), (F.col("n") - 1) * F.col("c") / (2 * F.col("w") * F.col("ss"))).otherwise(0.0)
    return own.crossJoin(F.broadcast(cross)).select("n", "w", F.round(c, 6).alias("gearys_c"))


def lisa(values: DataFrame, topo: DataFrame, limit: int | None = None) -> DataFrame:
    """Local Moran: value, z, local_i, lag, neighbor_count, cluster_type and significant per cell; `limit` keeps the strongest."""
    d = _with_stats(pairs(values, topo), values).where("sd > 0")
    z, zn = (F.col("v") - F.col("m")) / F.col("sd"), (F.col("v_n") - F.col("m")) / F.col("sd")
    x = d.groupBy("dggid", "v", "m", "sd").agg(F.sum(zn).alias("s"), F.count("*").alias("k")).withColumn("z", z).withColumn("lag", F.col("s") / F.col("k")).withColumn("i", F.col("z") * F.col("lag"))
    strong = F.abs("i") > 1.96
    quadrant = F.when((F.col("z") > 0) & (F.col("lag") > 0), "HH").when((F.col("z") < 0) & (F.col("lag") < 0), "LL").when((F.col("z") > 0) & (F.col("lag") < 0), "HL").when((F.col("z") < 0) & (F.col("lag") > 0), "LH").otherwise("NS")
    if limit is not None:  # by the statistic itself, before rounding
        x = x.orderBy(F.abs("i").desc(), "dggid").limit(min(max(limit, 1), 50_000))
    return x.select("dggid", F.col("v").alias("value"), F.round("z", 4).alias("z"), F.round("i", 4).alias("local_i"), F.round("lag", 4).alias("lag"), F.col("k").alias("neighbor_count"), F.when(strong, quadrant).otherwise("NS").alias("cluster_type"), strong.alias("significant"))


def hotspots(values: DataFrame, topo: DataFrame, include_self: bool = False, limit: int | None = None) -> DataFrame:
    """Gi per cell over its neighbours (and itself if asked): value, local_sum, neighbor_count, gi_z, type, significance."""
    p = pairs(values, topo)
    if include_self:
        own = values.where("value_num is not null").select("dggid", F.col("value_num").alias("v"), F.col("dggid").alias("neighbor"), F.col("value_num").alias("v_n"))
        p = p.unionByName(own)
    x = _with_stats(p.groupBy("dggid", "v").agg(F.sum("v_n").alias("local_sum"), F.count("*").alias("k")), values)
    spread = F.col("sd") * F.sqrt((F.col("n") * F.col("k") - F.col("k") * F.col("k")) / F.nullif(F.col("n") - 1, F.lit(0)))
    x = x.withColumn("gi", F.when((F.col("sd") > 0) & (F.col("n") > 1) & (spread > 0), (F.col("local_sum") - F.col("m") * F.col("k")) / F.nullif(spread, F.lit(0.0))).otherwise(0.0))
    if limit is not None:
        x = x.orderBy(F.desc("gi"), "dggid").limit(max(limit, 1))
    return x.select("dggid", F.col("v").alias("value"), "local_sum", F.col("k").alias("neighbor_count"), F.round("gi", 4).alias("gi_z"), F.when(F.col("gi") > 0, "hotspot").otherwise("coldspot").alias("type"), _significance(F.col("gi")).alias("significance"))


def focal_mean(values: DataFrame, topo: DataFrame) -> DataFrame:
    """The mean of each cell's neighbours."""
    return pairs(values, topo).groupBy("dggid").agg(F.avg("v_n").alias("focal_mean"), F.count("*").alias("neighbor_count"))


def boundary_cells(cells: DataFrame, topo: DataFrame) -> DataFrame:
    """Cells of a set with fewer than six neighbours in it."""
    ids = cells.select("dggid").distinct()
    inside = topo.select("dggid", "neighbor_dggid").distinct().join(ids, "dggid", "left_semi").join(ids.select(F.col("dggid").alias("neighbor_dggid")), "neighbor_dggid", "left_semi")
    return ids.join(inside.groupBy("dggid").agg(F.count("*").alias("k")), "dggid", "left").select("dggid", F.coalesce("k", F.lit(0)).cast("bigint").alias("neighbors_inside")).where("neighbors_inside < 6")


def contour(values: DataFrame, topo: DataFrame, levels: int = 10) -> DataFrame:
    """Cells at or above a threshold with a neighbour below it, for levels - 1 thresholds evenly between the extremes.

    A pair of neighbours crosses the thresholds in (v_n, v]; those are numbered directly, so no threshold table is joined.
    """
    if not 2 <= levels <= 50:
        raise ValueError("levels must be from 2 to 50")
    ends = values.where("value_num is not null").agg(F.min("value_num").alias("lo"), F.max("value_num").alias("hi"))
    low = pairs(values, topo).groupBy("dggid", "v").agg(F.min("v_n").alias("v_n")).where("v_n < v").crossJoin(F.broadcast(ends))
    x = low.select("dggid", "v", "v_n", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(levels - 1))).alias("level"))
    x = x.withColumn("threshold", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("level") / levels)
    return x.where("v >= threshold and v_n < threshold").select("dggid", "level", "threshold", F.col("v").alias("value"))


def change(before: DataFrame, after: DataFrame, threshold: float = 0.0, keep_stable: bool = False, limit: int | None = None) -> DataFrame:
    """Change per cell between two sets of values: before, after, abs_change, pct_change, change_type; `limit` keeps the greatest changes."""
    a, b = before.select("dggid", F.col("value_num").alias("before")), after.select("dggid", F.col("value_num").alias("after"))
    x = a.join(b, "dggid", "full_outer").withColumn("d", F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    kind = F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "disappeared").when(F.abs("d") <= threshold, "stable").when(F.col("d") > 0, "gain").otherwise("loss")
    pct = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), (F.col("after") - F.col("before")) / F.nullif(F.abs("before"), F.lit(0.0)) * 100)
    x = x.select("dggid", "before", "after", F.col("d").alias("abs_change"), pct.alias("pct_change"), kind.alias("change_type"))
    x = x if keep_stable else x.where("change_type != 'stable'")
    return x if limit is None else x.orderBy(F.abs("abs_change").desc(), "dggid").limit(max(limit, 1))


def spatial_regression(values: DataFrame, topo: DataFrame) -> DataFrame:
    """The line through (mean of the neighbours, value) over all cells: n, slope, intercept and r2, in one row."""
    x = pairs(values, topo).groupBy("dggid", "v").agg(F.avg("v_n").alias("lag"))
    return x.agg(F.count("*").alias("n"), F.regr_slope("v", "lag").alias("slope"), F.regr_intercept("v", "lag").alias("intercept"), F.regr_r2("v", "lag").alias("r2"))


def covariogram(values: DataFrame, topo: DataFrame, rings: int = 3) -> DataFrame:
    """Per distance, the number of ordered pairs of cells and their mean product of deviations: only pairs within `rings` steps are formed."""
    v = values.where("value_num is not null").select("dggid", F.col("value_num").alias("v"))
    near = hops(v.select("dggid", F.col("dggid").alias("source")), topo, min(max(rings, 1), 10), source="source")
    x = near.join(v, "dggid").join(v.select(F.col("dggid").alias("source"), F.col("v").alias("v_n")), "source")
    x = _with_stats(x, values)
    return x.groupBy(F.col("distance").cast("bigint").alias("distance")).agg(F.count("*").alias("pairs"), F.avg((F.col("v") - F.col("m")) * (F.col("v_n") - F.col("m"))).alias("covariance"))


def junctions(zones: DataFrame, topo: DataFrame, least: int = 3) -> DataFrame:
    """Cells where at least so many zones meet: their own and those of their neighbours. `zones` is (dggid, zone_id)."""
    z = zones.select("dggid", "zone_id").distinct()
    near = topo.select("dggid", "neighbor_dggid").distinct().join(z.withColumnRenamed("dggid", "neighbor_dggid"), "neighbor_dggid").join(z.select("dggid").distinct(), "dggid", "left_semi").select("dggid", "zone_id")
    return near.unionByName(z).groupBy("dggid").agg(F.countDistinct("zone_id").alias("zones")).where(F.col("zones") >= least)
