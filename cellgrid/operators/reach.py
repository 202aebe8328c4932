"""Operators that spread over the topology step by step.

Each step is one join of the state with the topology and one aggregate that keeps the best entry per key; a row from each
cell to itself carries the state along, so a step names the state once and k steps are one plan, and only cells that the last
step found go on to their neighbours. Walks of unknown length
write what each step finds and expand only that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import cut, cut_and_seen, dropped

#: Steps in one plan before it is cut.
PLAN_STEPS = 6
#: Tables of a shortest path's rounds before they become one.
KNOWN_TABLES = 8


def hops(seeds: DataFrame, topo: DataFrame, rings: int, mask: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """Cells within `rings` steps of the seeds with their least distance: (dggid, distance), or (source, dggid, distance).

    With a mask the walk enters only its cells; seeds need not be in it. With `source`, a column of `seeds`, distances are
    kept per source.
    """
    keys = ["dggid"] if source is None else [source, "dggid"]
    edges = topo.select("dggid", "neighbor_dggid").distinct()
    if mask is not None:
        edges = edges.join(mask.select(F.col("dggid").alias("neighbor_dggid")), "neighbor_dggid", "left_semi")
    start = seeds.select(*keys).distinct().withColumn("distance", F.lit(0))
    # the edges with a loop at every cell of seeds or edges: one reference to the state in each step
    loops = F.array(F.struct(F.col("dggid").alias("to"), F.lit(0).alias("step")))
    near = edges.groupBy("dggid").agg(F.collect_list(F.struct(F.col("neighbor_dggid").alias("to"), F.lit(1).alias("step"))).alias("near"))
    state = start
    for k in range(1, rings + 1):
        on = F.when(F.col("distance") == k - 1, F.concat(loops, "near"))  # all others have been where they lead
        x = state.join(near, "dggid", "left").select(*keys, "distance", F.explode(F.coalesce(on, loops)).alias("e"))
        carried = [F.col(source)] if source else []
        state = x.select(*carried, F.col("e.to").alias("dggid"), (F.col("distance") + F.col("e.step")).alias("distance")).groupBy(*keys).agg(F.min("distance").alias("distance"))
        if k % PLAN_STEPS == 0 and k < rings:
            state = cut(state)
    return state


def buffer(seeds: DataFrame, topo: DataFrame, rings: int = 1, max_cells: int | None = None) -> DataFrame:
    """Cells within 1 to 10 rings of the seeds, seeds included; with `max_cells` the nearest ones up to that number, by distance and id."""
    x = hops(seeds, topo, min(max(rings, 1), 10))
    return (x if max_cells is None else x.orderBy("distance", "dggid").limit(max_cells)).select("dggid")


def shrink(cells: DataFrame, topo: DataFrame, rings: int = 1) -> DataFrame:
    """A negative buffer: the cells of a set from which `rings` steps never leave it. A cell with fewer than six neighbours in the set is at its edge."""
    from .neighborhood import boundary_cells

    ids, edge = cells.select("dggid").distinct(), boundary_cells(cells, topo).select("dggid")
    gone = edge if rings <= 1 else hops(edge, topo, min(rings, 10) - 1, mask=ids).select("dggid")
    return ids.join(gone, "dggid", "left_anti")


def buffer_weighted(seeds: DataFrame, topo: DataFrame, rings: int = 1) -> DataFrame:
    """The buffer with 1 / (distance + 1) as value, and which cells are sources."""
    x = hops(seeds, topo, min(max(rings, 1), 10))
    return x.select("dggid", (F.lit(1.0) / (F.col("distance") + 1)).alias("value_num"), F.when(F.col("distance") == 0, "Source").otherwise("Buffer").alias("value_text"), F.col("distance").cast("bigint").alias("distance"))


def propagate(seeds: DataFrame, topo: DataFrame, mask: DataFrame | None, steps: int = 1) -> DataFrame:
    """Flood fill from the seeds through the mask's cells, 1 to 20 steps; without a mask, a buffer."""
    return hops(seeds, topo, min(max(steps, 1), 20), mask).select("dggid")


def walks(sources: DataFrame, topo: DataFrame, steps: int) -> DataFrame:
    """Every (source, dggid, distance) for which a walk of that length exists: the literal recursion, in which a source counts at several depths."""
    edges = topo.select("dggid", "neighbor_dggid").distinct()
    level = sources.select("source", "dggid").distinct().withColumn("distance", F.lit(0))
    out = level
    for k in range(1, steps + 1):
        level = level.join(edges, "dggid").select("source", F.col("neighbor_dggid").alias("dggid")).distinct().withColumn("distance", F.lit(k))
        level = cut(level) if k % PLAN_STEPS == 0 else level
        out = out.unionByName(level)
    return out


def _source_values(values: DataFrame, topo: DataFrame, rings: int, literal: bool) -> DataFrame:
    """(dggid, source, v, distance) for all cells that the measured ones reach."""
    v = values.where("value_num is not null").select(F.col("dggid").alias("source"), F.col("value_num").alias("v"))
    start = v.select("source", F.col("source").alias("dggid"))
    reached = walks(start, topo, rings) if literal else hops(start, topo, rings, source="source")
    return reached.join(v, "source")


def idw(values: DataFrame, topo: DataFrame, rings: int = 2, literal: bool = False) -> DataFrame:
    """Inverse squared distance weighting at cells without a value that at least two sources reach."""
    rings = min(max(rings, 1), 10)
    x = _source_values(values, topo, rings, literal).where("distance >= 1").join(values.where("value_num is not null").select("dggid"), "dggid", "left_anti")
    d2 = F.pow(F.greatest("distance", F.lit(1)).cast("double"), 2)
    return x.groupBy("dggid").agg((F.sum(F.col("v") / d2) / F.sum(1 / d2)).alias("value_num"), F.countDistinct("source").alias("sources")).where("sources >= 2")


def kernel_density(values: DataFrame, topo: DataFrame, bandwidth: int = 3, kernel: str = "gaussian", literal: bool = False) -> DataFrame:
    """The kernel-weighted mean of the values within `bandwidth` rings; in the literal form equal values at a depth merge."""
    bw = min(max(bandwidth, 1), 10)
    d = F.col("distance").cast("double")
    w = F.exp(-0.5 * F.pow(d / bw, 2)) if kernel == "gaussian" else F.greatest(F.lit(0.0), 1 - d / bw) if kernel == "linear" else F.lit(1.0)
    x = _source_values(values, topo, bw, literal)
    if literal:
        x = x.select("dggid", "distance", "v").distinct()
    x = x.withColumn("w", w)
    return x.groupBy("dggid").agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("density"), F.count("*").alias("contributions"))


def voronoi(seeds: DataFrame, topo: DataFrame, radius: int = 50) -> DataFrame:
    """The nearest seed of every cell within `radius` steps, of ties the smallest id: (dggid, seed, distance).

    Only the cells of the last step are expanded, and each step's new cells are written: with neighbours that are mutual
    they can only meet cells of the two steps before, so a step costs its frontier, not what was reached before. It ends
    when a step finds nothing.
    """
    radius = min(max(radius, 1), 100)
    edges = cut(topo.select("dggid", "neighbor_dggid").distinct())
    levels = [cut(seeds.select("dggid").distinct().select("dggid", F.col("dggid").alias("seed"), F.lit(0).cast("bigint").alias("distance")))]
    for k in range(1, radius + 1):
        near = levels[-1].join(edges, "dggid").groupBy(F.col("neighbor_dggid").alias("dggid")).agg(F.min("seed").alias("seed"))
        met = levels[-1].select("dggid") if k == 1 else levels[-1].select("dggid").union(levels[-2].select("dggid"))
        new, seen = cut_and_seen(near.join(met, "dggid", "left_anti").withColumn("distance", F.lit(k).cast("bigint")), F.count("dggid").alias("cells"))
        if not seen["cells"]:
            break
        levels.append(new)
    return reduce(DataFrame.unionByName, levels)


def zone_summary(zones: DataFrame) -> DataFrame:
    """Per seed, how many cells it is nearest to and their mean distance."""
    return zones.groupBy(F.col("seed").alias("zone_id")).agg(F.count("*").alias("cell_count"), F.avg("distance").alias("avg_distance"))


def visibility_summary(seen: DataFrame) -> DataFrame:
    """How many cells of a viewshed are visible and hidden."""
    return seen.groupBy(F.when(F.col("visible"), "visible").otherwise("hidden").alias("visibility")).agg(F.count("*").alias("cells"))


def viewshed(elevation: DataFrame, topo: DataFrame, observer: str, height: float = 1.8, radius: int = 20) -> DataFrame:
    """Cells within `radius` steps seen from `observer` by the angle test (e - observer's eye) / distance > -0.1: dggid, depth, elevation, visible."""
    radius = min(max(radius, 1), 50)
    e = elevation.where("value_num is not null").select("dggid", F.col("value_num").alias("elevation"))
    start = e.where(F.col("dggid") == observer)
    eye = start.select((F.col("elevation") + height).alias("eye"))
    x = hops(start, topo, radius).where("distance >= 1").join(e, "dggid").crossJoin(F.broadcast(eye))
    return x.select("dggid", F.col("distance").cast("bigint").alias("depth"), "elevation", ((F.col("elevation") - F.col("eye")) / F.greatest("distance", F.lit(1)) > -0.1).alias("visible"))


def line_of_sight(elevation: DataFrame, lattice, observer: str, height: float = 1.8, radius: int = 20) -> DataFrame:
    """Cells within `radius` steps that no cell on the straight line from `observer` hides: dggid, depth, elevation, visible.

    Each target's line is sampled once per step and rounded to cells; it is seen if its angle is not below the greatest on
    the way. All lines are rows of one join with the elevations.
    """
    radius = min(max(radius, 1), 50)
    e = elevation.where("value_num is not null").select("dggid", F.col("value_num").alias("elevation"))
    o = e.where(F.col("dggid") == observer).select(lattice.parse(F.col("dggid")).alias("o"), (F.col("elevation") + height).alias("eye"))
    t = e.withColumn("p", lattice.parse(F.col("dggid"))).crossJoin(F.broadcast(o)).withColumn("depth", lattice.distance(F.col("dggid"), F.lit(observer)))
    t = t.where((F.col("depth") >= 1) & (F.col("depth") <= radius) & (F.col("p.level") == F.col("o.level")))
    way = t.select("dggid", "elevation", "depth", "eye", "p", "o", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("depth"))).alias("k"))
    at = lambda x: F.round(F.col(f"o.{x}") + (F.col(f"p.{x}") - F.col(f"o.{x}")) * F.col("k") / F.col("depth")).cast("bigint")
    way = way.withColumn("here", lattice.cell_id(F.col("p.level"), at("q"), at("r"))).join(e.select(F.col("dggid").alias("here"), F.col("elevation").alias("e")), "here", "left")
    slope = (F.col("e") - F.col("eye")) / F.col("k")
    seen = way.groupBy("dggid", "depth", "elevation", "eye").agg(F.max(F.when(F.col("k") < F.col("depth"), slope)).alias("most"))
    own = (F.col("elevation") - F.col("eye")) / F.col("depth")
    return seen.select("dggid", "depth", "elevation", (F.col("most").isNull() | (own >= F.col("most"))).alias("visible"))


def nearest(sources: DataFrame, targets: DataFrame, topo: DataFrame, radius: int = 50) -> DataFrame:
    """For each source cell its nearest target and the distance."""
    return voronoi(targets, topo, radius).join(sources.select("dggid").distinct(), "dggid", "left_semi").select("dggid", F.col("seed").alias("nearest"), "distance")


def shortest_path(topo: DataFrame, start: str, end: str, cost: DataFrame | None = None, max_hops: int = 100) -> DataFrame:
    """The cheapest path as one row: found, total_cost, hops, path. A path costs the sum over the cells it enters (1 where none is known).

    Synchronous relaxation: after round k each cell holds its least (cost, hops, cell before) by at most k steps; only cells
    that a round improved are expanded in the next, and none that costs as much as the best way to `end` so far. A round
    writes only what it improved; the tables of several rounds become one when there are many. Costs must not be negative. The path itself is walked back from `end` along the cells before, doubling the stretch in every round.
    """
    spark, max_hops = topo.sparkSession, min(max(max_hops, 1), 500)
    edges = topo.select("dggid", "neighbor_dggid").distinct()
    if cost is not None:
        edges = edges.join(cost.select(F.col("dggid").alias("neighbor_dggid"), F.col("value_num").alias("c")), "neighbor_dggid", "left")
    else:
        edges = edges.withColumn("c", F.lit(None).cast("double"))
    edges = cut(edges.select("dggid", F.col("neighbor_dggid").alias("to"), F.coalesce("c", F.lit(1.0)).alias("c")))
    best = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("before"))
    least = F.min("best").alias("best")
    known = [spark.range(1).select(F.lit(start).alias("dggid"), best.alias("best"))]
    reached, old = Row(cost=0.0, hops=0) if start == end else None, []
    for _ in range(max_hops):
        front = known[-1] if reached is None else known[-1].where(F.col("best.cost") < reached.cost)
        step = F.struct((F.col("best.cost") + F.col("c")).alias("cost"), (F.col("best.hops") + 1).alias("hops"), F.col("dggid").alias("before"))
        found = front.join(edges, "dggid").select(F.col("to").alias("dggid"), step.alias("best")).groupBy("dggid").agg(least)
        held = reduce(DataFrame.unionByName, known).withColumnRenamed("best", "held")
        both = found.join(held, "dggid", "left").groupBy("dggid").agg(least, F.min("held").alias("held"))
        better = both.where(F.col("held").isNull() | (F.col("best") < F.col("held"))).select("dggid", "best")
        new, seen = cut_and_seen(better, F.count("dggid").alias("cells"), F.min(F.when(F.col("dggid") == end, F.col("best"))).alias("end"))
        dropped(*old)
        old = []
        if not seen["cells"]:
            dropped(new)
            break
        reached = seen["end"] or reached
        if len(known) > KNOWN_TABLES:
            old, known = known, [cut(reduce(DataFrame.unionByName, known).groupBy("dggid").agg(least))]
        known.append(new)
    way = reduce(DataFrame.unionByName, known).groupBy("dggid").agg(least).select("dggid", F.col("best.before").alias("before"))
    line, stretch, far = spark.range(1).select(F.lit(end).alias("dggid"), F.lit(0).alias("back")), cut(way.where("before is not null")), 1
    dropped(*known, *old)
    length = reached.hops if reached else 0
    while far <= length:
        ahead = line.join(stretch, "dggid").select(F.col("before").alias("dggid"), (F.col("back") + far).alias("back"))
        longer, far = cut(line.unionByName(ahead)), 2 * far
        if far <= length:
            stretch = cut(stretch.join(stretch.select(F.col("dggid").alias("before"), F.col("before").alias("_far")), "before").select("dggid", F.col("_far").alias("before")))
        line = longer
    cells = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "dggid")))  # at most max_hops cells
    cost, steps = (reached.cost, reached.hops) if reached else (None, None)
    return line.agg(cells.alias("p")).select(
        F.lit(reached is not None).alias("found"), F.lit(cost).cast("double").alias("total_cost"), F.lit(steps).cast("bigint").alias("hops"), F.when(F.lit(reached is not None), F.col("p.dggid")).alias("path")
    )
