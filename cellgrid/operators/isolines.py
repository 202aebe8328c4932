"""Isolines as lines: where a surface over cell centres crosses a threshold, in order along each line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_and_seen, dropped


def triangles(values: DataFrame, topo: DataFrame, places: DataFrame) -> DataFrame:
    """All triples of cells that are each other's neighbours and have a value, counter-clockwise: a, b, c, each (id, v, x, y).

    Each cell gathers its neighbours with greater ids (six at most on a hexagon grid) and pairs those; a pair that the
    topology does not hold is no side. `places` is (dggid, x, y).
    """
    v = values.where("value_num is not null").join(places, "dggid").select("dggid", F.struct(F.col("dggid").alias("id"), F.col("value_num").alias("v"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("c"))
    ends = F.least("dggid", "neighbor_dggid").alias("lo"), F.greatest("dggid", "neighbor_dggid").alias("hi")
    sides = topo.where("dggid != neighbor_dggid").select(*ends).distinct()
    near = sides.join(v.select(F.col("dggid").alias("hi"), "c"), "hi").groupBy("lo").agg(F.collect_list("c").alias("near"))
    pairs = F.expr("flatten(transform(near, b -> transform(filter(near, c -> c.id > b.id), c -> struct(b, c))))")
    x = near.join(v.select(F.col("dggid").alias("lo"), F.col("c").alias("a")), "lo").select("a", F.explode(pairs).alias("p")).select("a", F.col("p.b").alias("b"), F.col("p.c").alias("c"))
    x = x.join(sides, (F.col("b.id") == F.col("lo")) & (F.col("c.id") == F.col("hi")), "left_semi")
    turn = (F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("b.y") - F.col("a.y")) * (F.col("c.x") - F.col("a.x"))
    return x.select("a", F.when(turn < 0, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turn < 0, F.col("b")).otherwise(F.col("c")).alias("c"))


def segments(corners: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The directed segments of all isolines, higher values on their left: level, threshold, start and end, each (v, x, y).

    A triangle that a threshold crosses has one side on which the surface falls below it, counter-clockwise, and one on
    which it rises again: the segment goes from the first to the second. Neighbouring triangles see their common side the
    other way round, so every segment ends where the next starts. `thresholds` is one row, (at: array of (level, threshold)).
    """
    least, most = F.least("a.v", "b.v", "c.v"), F.greatest("a.v", "b.v", "c.v")
    x = corners.crossJoin(F.broadcast(thresholds)).withColumn("t", F.explode("at")).where((least < F.col("t.threshold")) & (most >= F.col("t.threshold")))
    above = lambda c: F.col(f"{c}.v") >= F.col("t.threshold")

    def crossing(hi: str, lo: str) -> Column:
        part = (F.col(f"{hi}.v") - F.col("t.threshold")) / (F.col(f"{hi}.v") - F.col(f"{lo}.v"))
        at = [(F.col(f"{hi}.{k}") + (F.col(f"{lo}.{k}") - F.col(f"{hi}.{k}")) * part).alias(k) for k in "xy"]
        return F.struct(F.concat_ws(">", f"{hi}.id", f"{lo}.id").alias("v"), *at)

    around = (("a", "b"), ("b", "c"), ("c", "a"))
    falls = F.coalesce(*[F.when(above(p) & ~above(q), crossing(p, q)) for p, q in around])
    rises = F.coalesce(*[F.when(~above(p) & above(q), crossing(q, p)) for p, q in around])
    return x.select("t.level", "t.threshold", falls.alias("start"), rises.alias("end"))


def even_thresholds(values: DataFrame, levels: int) -> DataFrame:
    """levels - 1 thresholds evenly between the extremes, numbered from 1, as one row."""
    if not 2 <= levels <= 50:
        raise ValueError("levels must be from 2 to 50")
    ends = values.where("value_num is not null").agg(F.min("value_num").alias("lo"), F.max("value_num").alias("hi"))
    each = [F.struct(F.lit(k).alias("level"), (F.col("lo") + (F.col("hi") - F.col("lo")) * k / levels).alias("threshold")) for k in range(1, levels)]
    return ends.select(F.array(*each).alias("at"))


def isolines(values: DataFrame, topo: DataFrame, places: DataFrame, levels: int = 10) -> DataFrame:
    """The points of every isoline, one row each: level, threshold, line, closed, remaining, x, y.

    `remaining` counts the points of the line that come after this one, so it orders the line downwards; a closed line goes
    from its last point back to its first. Where cells are missing lines are open. `line` is the last point's pair of cells.

    Lines are ordered by list ranking, however long: each point knows the least label among the next 2^k points and how far it
    is. An end is the least label of its line; where there is none the least point is. A round doubles the stretch, and joins
    each point that has not seen an end with one other point, so no key is hot. It ends when no label changes.
    """
    found = cut(segments(triangles(values, topo, places), even_thresholds(values, levels)))
    both = reduce(DataFrame.union, [found.select("level", "threshold", c) for c in ("start", "end")]).toDF("level", "threshold", "p")
    points = cut(both.groupBy("level", F.col("p.v").alias("v")).agg(F.first("threshold").alias("threshold"), F.first("p").alias("p")))
    following = found.select("level", F.col("start.v").alias("v"), F.col("end.v").alias("jump"))
    best = F.struct(F.col("jump").isNotNull().alias("closed"), F.col("v").alias("line"), F.lit(0).cast("bigint").alias("remaining"))
    state = cut(points.select("level", "v").join(following, ["level", "v"], "left").select("level", "v", "jump", best.alias("best"), F.lit(False).alias("changed")))
    step = 1
    while True:
        ahead = state.select("level", F.col("v").alias("jump"), F.col("jump").alias("far"), F.col("best").alias("other"))
        other = F.struct("other.closed", "other.line", (F.col("other.remaining") + step).alias("remaining"))
        changed = (F.col("other.closed") < F.col("best.closed")) | (F.col("other.line") < F.col("best.line"))
        moved = state.where("best.closed").join(ahead, ["level", "jump"]).select("level", "v", F.col("far").alias("jump"), F.least("best", other).alias("best"), changed.alias("changed"))
        after, seen = cut_and_seen(state.where("not best.closed").withColumn("changed", F.lit(False)).unionByName(moved), F.max("changed").alias("changed"))
        dropped(state)
        state, step = after, 2 * step
        if not seen["changed"]:
            break
    return state.select("level", "v", "best").join(points, ["level", "v"]).select("level", "threshold", "best.line", "best.closed", "best.remaining", "p.x", "p.y")
