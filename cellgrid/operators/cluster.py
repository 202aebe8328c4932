"""Density clusters of adjacent cells with similar values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_and_seen, dropped, running_total
from .neighborhood import pairs
from .reach import hops


def similar_pairs(values: DataFrame, topo: DataFrame, threshold: float = 0.5, rings: int = 1) -> DataFrame:
    """(dggid, neighbor) of cells within `rings` steps whose values differ by at most threshold population deviations."""
    s = values.where("value_num is not null").agg(F.stddev_pop("value_num").alias("sd"))
    limit = F.when((F.col("sd") > 0), F.col("sd") * threshold).otherwise(1.0)
    if rings > 1:
        near = hops(values.select("dggid", F.col("dggid").alias("source")), topo, rings, source="source").where("distance > 0").select(F.col("source").alias("dggid"), F.col("dggid").alias("neighbor_dggid"))
    else:
        near = topo
    return pairs(values, near).crossJoin(F.broadcast(s)).where(F.abs(F.col("v") - F.col("v_n")) <= limit).select("dggid", "neighbor")


def core_counts(values: DataFrame, topo: DataFrame, min_points: int = 3, threshold: float = 0.5) -> DataFrame:
    """Each cell's number of similar neighbours and whether it is a core."""
    n = similar_pairs(values, topo, threshold).groupBy("dggid").agg(F.count("*").alias("n"))
    return values.where("value_num is not null").join(n, "dggid", "left").select("dggid", F.coalesce("n", F.lit(0)).cast("bigint").alias("similar"), (F.coalesce("n", F.lit(0)) >= min_points).alias("core"))


def least_labels(edges: DataFrame) -> DataFrame:
    """(dggid, label): the smallest id that each end of `edges` (dggid, neighbor; both ways) reaches, by pointer jumping."""
    edges = cut(edges)
    labels = cut(edges.groupBy("dggid").agg(F.least(F.min("neighbor"), F.first("dggid")).alias("label")))
    while True:
        low = edges.join(labels.withColumnRenamed("dggid", "neighbor"), "neighbor").groupBy("dggid").agg(F.min("label").alias("low"))
        low = labels.join(low, "dggid").select("dggid", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("dggid").alias("low"), F.col("label").alias("far"))
        step = low.join(jump, "low").select("dggid", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved"))
        after, seen = cut_and_seen(step, F.max("moved").alias("moved"))
        dropped(labels)
        labels = after.select("dggid", "label")
        if not seen["moved"]:
            dropped(edges)
            return labels


def dbscan(values: DataFrame, topo: DataFrame, min_points: int = 3, threshold: float = 0.5, rings: int = 1) -> DataFrame:
    """(dggid, cluster_id): components of cores numbered from 0 by their smallest id; -1 is noise.

    A cell that is no core joins the component with the smallest id among its cores, if that id is below its own: what a
    scan of the cells in id order gives.
    """
    near = cut(similar_pairs(values, topo, threshold, rings))
    cores = near.groupBy("dggid").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("dggid")
    to_core = near.join(cores.select(F.col("dggid").alias("neighbor")), "neighbor", "left_semi")
    links = to_core.join(cores, "dggid", "left_semi").select("dggid", "neighbor")
    labels = least_labels(links.unionByName(cores.select("dggid", F.col("dggid").alias("neighbor"))))
    rim = to_core.join(cores, "dggid", "left_anti").join(labels.withColumnRenamed("dggid", "neighbor"), "neighbor").groupBy("dggid").agg(F.min("label").alias("label")).where("label < dggid")
    named = cut(labels.unionByName(rim))
    numbers = running_total(named.select("label").distinct().withColumn("one", F.lit(1)), "label", "one", "upto").select("label", (F.col("upto") - 1).cast("bigint").alias("cluster_id"))
    x = values.where("value_num is not null").select("dggid").join(named, "dggid", "left").join(numbers, "label", "left")
    return x.select("dggid", F.coalesce("cluster_id", F.lit(-1)).cast("bigint").alias("cluster_id"))


def cluster_summary(values: DataFrame, clusters: DataFrame) -> DataFrame:
    """Size, mean and extremes of each cluster, largest first."""
    x = clusters.where("cluster_id >= 0").join(values.select("dggid", "value_num"), "dggid")
    return x.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("value_num").alias("mean"), F.min("value_num").alias("min"), F.max("value_num").alias("max")).orderBy(F.desc("size"), "cluster_id")
