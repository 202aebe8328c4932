"""Hierarchy operators: roll-ups to parents, pyramids, expansion to children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLLUPS = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev}


def rollup(values: DataFrame, parents: DataFrame, how: str = "avg", literal: bool = False) -> DataFrame:
    """One value per parent of `values` (dggid, value_num), with the number of children.

    `parents` (dggid, parent_dggid) may have a row for every neighbour, as a topology has; each child counts once, unless
    `literal` asks for one count per row.
    """
    if how not in ROLLUPS:
        raise ValueError(f"unknown roll-up {how}")
    up = parents.where("parent_dggid is not null").select("dggid", "parent_dggid")
    x = values.where("value_num is not null").join(up if literal else up.distinct(), "dggid")
    return x.groupBy("parent_dggid").agg(ROLLUPS[how]("value_num").alias("value_num"), F.count("*").alias("child_count"))


def rollup_cells(cells: DataFrame, parents: DataFrame, how: str = "mean") -> DataFrame:
    """Cell objects one level up: one value per (parent, tid, attr_key), so that attributes and times stay apart. `mode` takes the most frequent text, of ties the smallest."""
    up = parents.where("parent_dggid is not null").select("dggid", "parent_dggid").distinct()
    key = [F.col("parent_dggid").alias("dggid"), "tid", "attr_key"]
    return _cell_rollup(cells.join(up, "dggid").drop("dggid"), key, how)


def cube_rollup(cells: DataFrame, parent, from_level: int, to_level: int, how: str = "mean") -> DataFrame:
    """Cell objects of `from_level` at the coarser `to_level`, per (ancestor, tid, attr_key), in one aggregate from the finest cells. `parent` maps an id column to its parent's."""
    if to_level >= from_level:
        raise ValueError("to_level must be coarser than from_level")
    c = F.col("dggid")
    for _ in range(from_level - to_level):
        c = parent(c)
    x = cells.withColumn("dggid", c).where("dggid is not null")
    return _cell_rollup(x, ["dggid", "tid", "attr_key"], how)


def _cell_rollup(cells: DataFrame, key: list, how: str) -> DataFrame:
    number = F.lit(None).cast("double").alias("value_num")
    if how == "mode":
        n = cells.where("value_text is not null").groupBy(*key, "value_text").agg(F.count("*").alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("n"), "value_text")).getField("value_text")
        return n.groupBy("dggid", "tid", "attr_key").agg(best.alias("value_text")).select("dggid", "tid", "attr_key", "value_text", number)
    if how not in ROLLUPS:
        raise ValueError(f"unknown roll-up {how}")
    x = cells.where("value_num is not null").groupBy(*key).agg(ROLLUPS[how]("value_num").cast("double").alias("value_num"))
    return x.select("dggid", "tid", "attr_key", F.lit(None).cast("string").alias("value_text"), "value_num")


def rollup_mode(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """The most frequent label of each parent's children, of ties the smallest; `labels` has dggid and value_text."""
    n = labels.where("value_text is not null").join(parents.where("parent_dggid is not null").select("dggid", "parent_dggid").distinct(), "dggid").groupBy("parent_dggid", "value_text").agg(F.count("*").alias("n"))
    best = n.groupBy("parent_dggid").agg(F.min(F.struct((-F.col("n")).alias("n"), "value_text")).alias("m"))
    return best.select("parent_dggid", "m.value_text", (-F.col("m.n")).alias("n"))


def pyramid(values: DataFrame, parent, from_level: int, to_level: int = 1, how: str = "mean") -> DataFrame:
    """Chained roll-ups, level by level: (level, dggid, value_num). `parent` maps an id column to its parent's.

    Each level is aggregated from the one below, so the work shrinks by the aperture from level to level.
    """
    level, out = values.select("dggid", "value_num"), None
    for k in range(from_level - 1, to_level - 1, -1):
        level = level.where("value_num is not null").groupBy(parent(F.col("dggid")).alias("dggid")).agg(ROLLUPS[how]("value_num").alias("value_num"))
        step = level.select(F.lit(k).alias("level"), "dggid", "value_num")
        out = step if out is None else out.unionByName(step)
    if out is None:
        raise ValueError("to_level must be below from_level")
    return out


def ancestors(ids: DataFrame, parent, levels: int) -> DataFrame:
    """Distinct ancestors `levels` steps up."""
    c: Column = F.col("dggid")
    for _ in range(levels):
        c = parent(c)
    return ids.select(c.alias("dggid")).where("dggid is not null").distinct()


def expand(ids: DataFrame, children, iterations: int) -> DataFrame:
    """Distinct descendants `iterations` steps down."""
    for _ in range(iterations):
        ids = ids.select(F.explode(children(F.col("dggid"))).alias("dggid"))
    return ids.distinct()
