"""Surface flow: steepest descent, what gathers downstream, drainage basins and the filling of depressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_and_seen, dropped
from .neighborhood import boundary_cells, pairs

#: The basin of all that drains over an outlet. No cell has this id.
OUTSIDE = ""


def flow_direction(elevation: DataFrame, topo: DataFrame) -> DataFrame:
    """Each cell's lowest strictly lower neighbour (of ties the smallest id): dggid, target, drop, source_elev, target_elev; sinks have no row."""
    x = pairs(elevation, topo).where("v_n < v").groupBy("dggid", "v").agg(F.min(F.struct("v_n", "neighbor")).alias("low"))
    return x.select("dggid", F.col("low.neighbor").alias("target"), (F.col("v") - F.col("low.v_n")).alias("drop"), F.col("v").alias("source_elev"), F.col("low.v_n").alias("target_elev"))


def upstream_counts(direction: DataFrame) -> DataFrame:
    """How many cells flow directly into each."""
    return direction.groupBy(F.col("target").alias("dggid")).agg(F.count("*").alias("upstream"))


def flow_accumulation(elevation: DataFrame, direction: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Each cell itself and all cells upstream of it: (dggid, flow).

    The pointers form a forest. Pointers double in each round: with the counts over paths shorter than 2^k and the pointers
    over 2^k steps, one join gives both for k + 1; so the rounds grow with the logarithm of the longest path, and paths are
    never listed. It ends when no pointer is left, or where paths reach `max_depth`, if given (the next power of two).
    """
    start = elevation.where("value_num is not null").select("dggid", F.lit(1).cast("bigint").alias("flow"))
    pointers = F.count("target").alias("pointers")
    state, seen = cut_and_seen(start.join(direction.select("dggid", "target"), "dggid", "left"), pointers)
    reach = 1
    while seen["pointers"] and (max_depth is None or reach < max_depth):
        sent = state.where("target is not null").groupBy(F.col("target").alias("dggid")).agg(F.sum("flow").alias("more"))
        far = state.select(F.col("dggid").alias("target"), F.col("target").alias("far"))
        ahead = state.join(far, "target", "left").select("dggid", "flow", F.col("far").alias("target"))
        step = ahead.join(sent, "dggid", "left").select("dggid", (F.col("flow") + F.coalesce("more", F.lit(0))).alias("flow"), "target")
        after, seen = cut_and_seen(step, pointers)
        dropped(state)
        state = after
        reach *= 2
    return state.select("dggid", "flow")


def roots(pointers: DataFrame) -> DataFrame:
    """The root of every node of a forest (id, target), targets null at roots: (id, root).

    Pointers double in each round, and only nodes that have not met their root take part, so the rounds grow with the
    logarithm of the depth and no join is on a root.
    """
    ends = pointers.select(F.col("id").alias("target"), F.col("target").isNull().alias("at_root"))
    first = pointers.where("target is not null").join(ends, "target").select("id", F.col("target").alias("jump"), "at_root")
    start = pointers.where("target is null").select("id", F.col("id").alias("jump"), F.lit(True).alias("at_root")).unionByName(first)
    on_the_way = F.sum(F.when(~F.col("at_root"), 1)).alias("open")
    state, seen = cut_and_seen(start, on_the_way)
    while seen["open"]:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("at_root").alias("there"))
        moved = state.where("not at_root").join(ahead, "jump").select("id", F.col("far").alias("jump"), F.col("there").alias("at_root"))
        after, seen = cut_and_seen(state.where("at_root").unionByName(moved), on_the_way)
        dropped(state)
        state = after
    return state.select("id", F.col("jump").alias("root"))


def basins(elevation: DataFrame, topo: DataFrame) -> DataFrame:
    """The sink that each cell drains to by steepest descent: (dggid, sink). A sink is its own; a flat floor has several."""
    cells = elevation.where("value_num is not null").select(F.col("dggid").alias("id"))
    down = flow_direction(elevation, topo).select(F.col("dggid").alias("id"), "target")
    return roots(cells.join(down, "id", "left")).select(F.col("id").alias("dggid"), F.col("root").alias("sink"))


def _lowest_passes(passes: DataFrame) -> DataFrame:
    """Passes (a, b, height) with the ends in order, the lowest of each pair, none from a basin to itself."""
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return passes.where("a != b").select(*ends, "height").groupBy("a", "b").agg(F.min("height").alias("height"))


def fill_depressions(elevation: DataFrame, topo: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """The level to which water stands before it runs off over an outlet: (dggid, elevation, filled, depth).

    Outlets are cells from which water leaves: those given (dggid), else the cells with fewer than six neighbours. `filled` is
    the least, over all ways to an outlet, of a way's highest cell; null where no way leads to one.

    Cells drain into basins, and basins meet at passes. In each round every group of basins that does not reach the outside takes
    its lowest pass, and the groups so joined become one. A way out of a basin leaves each of its groups, and each pass taken
    leads on by lower ones, so a basin's level is the highest pass that its groups took. Groups halve in number in each round.
    """
    cells = elevation.where("value_num is not null").select("dggid", F.col("value_num").alias("v"))
    leave = (boundary_cells(cells, topo) if outlets is None else outlets).select("dggid").distinct().withColumn("out", F.lit(True))
    down = flow_direction(elevation, topo).select("dggid", "target")
    pointers = cells.select("dggid").join(leave, "dggid", "left").join(down, "dggid", "left").select(F.col("dggid").alias("id"), F.when(F.col("out"), OUTSIDE).otherwise(F.col("target")).alias("target"))
    outside = elevation.sparkSession.range(1).select(F.lit(OUTSIDE).alias("id"), F.lit(None).cast("string").alias("target"))
    drained = cut(cells.join(roots(pointers.unionByName(outside)).select(F.col("id").alias("dggid"), F.col("root").alias("basin")), "dggid"))
    here, there = drained.select("dggid", F.col("v").alias("va"), F.col("basin").alias("a")), drained.select(F.col("dggid").alias("neighbor_dggid"), F.col("v").alias("vb"), F.col("basin").alias("b"))
    meet = topo.select("dggid", "neighbor_dggid").join(here, "dggid").join(there, "neighbor_dggid").select("a", "b", F.greatest("va", "vb").alias("height"))
    passes, seen = cut_and_seen(_lowest_passes(meet), F.count("a").alias("passes"))
    groups = cut(drained.where(F.col("basin") != OUTSIDE).select("basin").distinct().select("basin", F.col("basin").alias("grp"), F.lit(None).cast("double").alias("level")))
    while seen["passes"]:
        order = F.struct("height", "a", "b")  # one order of all passes, so that groups never choose in a ring
        ends = passes.select(F.col("a").alias("id"), F.col("b").alias("other"), order.alias("by")).union(passes.select("b", "a", order)).where(F.col("id") != OUTSIDE)
        taken = cut(ends.groupBy("id").agg(F.min(F.struct("by", "other")).alias("m")).select("id", F.col("m.by.height").alias("height"), F.col("m.other").alias("target")))
        back = taken.select(F.col("id").alias("target"), F.col("target").alias("theirs"))
        mutual = (F.col("theirs") == F.col("id")) & (F.col("id") < F.col("target"))
        tree = taken.join(back, "target", "left").select("id", F.when(mutual, None).otherwise(F.col("target")).alias("target"))
        joined = cut(roots(tree.unionByName(outside)).join(taken.select("id", "height"), "id", "left"))
        named = joined.select(F.col("id").alias("grp"), "root", "height")
        groups_after = cut(groups.join(named, "grp", "left").select("basin", F.coalesce("root", "grp").alias("grp"), F.greatest("level", "height").alias("level")))
        a, b = (joined.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        renamed = passes.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"), "height")
        passes_after, seen = cut_and_seen(_lowest_passes(renamed), F.count("a").alias("passes"))
        dropped(passes, groups, taken, joined)
        passes, groups = passes_after, groups_after
    reached = groups.select("basin", F.when(F.col("grp") == OUTSIDE, F.col("level")).alias("level"))
    filled = F.when(F.col("basin") == OUTSIDE, F.col("v")).when(F.col("level").isNotNull(), F.greatest("v", "level"))
    x = drained.join(reached, "basin", "left").select("dggid", F.col("v").alias("elevation"), filled.alias("filled"))
    return x.withColumn("depth", F.col("filled") - F.col("elevation"))
