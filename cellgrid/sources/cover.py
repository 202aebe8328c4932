"""Covers of polygons and boxes by cells of several levels.

A cell's descendants all have their centres within a fixed number of circumradii of its own. A cell whose surroundings of that
size are wholly inside stays as it is, however fine the level that is asked for; one that is wholly outside goes; only cells at an
edge are split into their three children. So the rows grow with the length of the edge, not with the area. The whole descent
is one chain of projections and explodes: nothing is shuffled, and each row carries only those edges that come near it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import in_ring
from ..grid import RADIUS_DEG, HexLattice, once

#: How far the centres of a cell's descendants lie from its own at most, in its circumradii: each level adds its own circumradius, a root of three smaller than the one before.
REACH = 1 / (1 - 1 / math.sqrt(3))


def _rectangle(grid: HexLattice, level: int, q: Column, r: Column, reach: float) -> Column:
    """struct(x, y, w, s, e, n): a cell's centre and what lies around it, in degrees; what is beyond a pole has a latitude beyond 90, so that no shape holds it."""
    size, turn = grid.size * 3 ** (-level / 2), level * math.pi / 6
    x0, y0 = size * math.sqrt(3) * (q + r / 2), size * 1.5 * r
    x, y = x0 * math.cos(turn) - y0 * math.sin(turn), x0 * math.sin(turn) + y0 * math.cos(turn)
    far = reach * size * (1 + 1e-9)
    lat = lambda v: F.when(F.abs(v) > RADIUS_DEG, F.signum(v) * 91.0).otherwise(F.asin(v / RADIUS_DEG) * RADIUS_DEG)
    return F.struct(x.alias("x"), lat(y).alias("y"), (x - far).alias("w"), lat(y - far).alias("s"), (x + far).alias("e"), lat(y + far).alias("n"))


def _meets(edge: Column, box: Column) -> Column:
    """Whether an edge, struct(ax, ay, bx, by), comes into a box: their extents overlap and the edge's line has corners on both sides."""
    ax, ay, bx, by = (edge[k] for k in ("ax", "ay", "bx", "by"))
    side = lambda x, y: (bx - ax) * (box[y] - ay) - (by - ay) * (box[x] - ax)
    corners = [side(x, y) for x in "we" for y in "sn"]
    overlap = (F.least(ax, bx) <= box["e"]) & (F.greatest(ax, bx) >= box["w"]) & (F.least(ay, by) <= box["n"]) & (F.greatest(ay, by) >= box["s"])
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def _roots(p: DataFrame, grid: HexLattice) -> DataFrame:
    """p (with the box w, s, e, n) with the level-0 cells whose descendants may lie in it, as struct at(l, q, r)."""
    far = REACH * grid.size
    y = lambda c: F.sin(F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col(c))))) * RADIUS_DEG
    whole = lambda v: F.ceil(v).cast("bigint")
    row = grid.size * 1.5
    p = p.withColumn("_r", F.explode(F.sequence(whole((y("s") - far) / row), whole((y("n") + far) / row))))
    col = lambda c, way: whole((F.col(c) + way * far) / (grid.size * math.sqrt(3)) - F.col("_r") / 2)
    p = p.withColumn("_q", F.explode(F.sequence(col("w", -1), col("e", 1))))
    return p.withColumn("at", F.struct(F.lit(0).alias("l"), F.col("_q").alias("q"), F.col("_r").alias("r"))).drop("_q", "_r")


def _children(at: Column) -> Column:
    q, r = at["q"], at["r"]
    return F.array(*[F.struct((at["l"] + 1).alias("l"), (2 * q + r + d).alias("q"), (r - q).alias("r")) for d in (0, 1, -1)])


def _descended(p: DataFrame, grid: HexLattice, level: int, looked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """p with one row for each cell `at` of its cover. `looked` sets `_whole` and `_gone` by `_box`; at the last level a box is the centre alone."""
    x = _roots(p, grid).withColumn("_whole", F.lit(False))
    for k in range(level + 1):
        box = _rectangle(grid, k, F.col("at.q"), F.col("at.r"), REACH if k < level else 0.0)
        x = x.withColumn("_box", F.explode(F.array(box)))  # once for all that looks at it
        x = looked(x).where("_whole OR NOT _gone").drop("_box", "_gone")
        if k < level:
            x = x.withColumn("at", F.explode(F.when(F.col("_whole"), F.array("at")).otherwise(_children(F.col("at")))))
    return x


def cover_boxes(p: DataFrame, grid: HexLattice, level: int) -> DataFrame:
    """p (with the box w, s, e, n in degrees, edges included) with the cells (dggid, cell_level) that cover it: those of `level` or their ancestors."""
    def looked(x: DataFrame) -> DataFrame:
        b = F.col("_box")
        inside = (b["w"] >= F.col("w")) & (b["e"] <= F.col("e")) & (b["s"] >= F.col("s")) & (b["n"] <= F.col("n"))
        apart = (b["w"] > F.col("e")) | (b["e"] < F.col("w")) | (b["s"] > F.col("n")) | (b["n"] < F.col("s"))
        return x.withColumn("_gone", ~F.col("_whole") & apart).withColumn("_whole", F.col("_whole") | inside)

    x = _descended(p.where("w <= e AND s <= n"), grid, level, looked)
    return x.select(*p.columns, grid.cell_id(F.col("at.l"), F.col("at.q"), F.col("at.r")).alias("dggid"), F.col("at.l").alias("cell_level"))


def cover_polygons(p: DataFrame, grid: HexLattice, level: int) -> DataFrame:
    """p (with `rings`, array of rings of struct(lon, lat), holes included) with the cells (dggid, cell_level) that cover it.

    A cell of `level` belongs to it if its centre is inside an odd number of rings, a coarser one if all its descendants do.
    """
    def looked(x: DataFrame) -> DataFrame:
        b = F.col("_box")
        x = x.withColumn("_edges", F.when(F.col("_whole"), F.slice("_edges", 1, 0)).otherwise(F.filter("_edges", lambda e: _meets(e, b))))
        odd = F.aggregate("rings", F.lit(0), lambda k, ring: k + in_ring(b["x"], b["y"], ring).cast("int")) % 2 == 1
        free = F.when(F.col("_whole"), True).when(F.size("_edges") == 0, odd)  # null: an edge comes near
        x = x.withColumn("_free", F.explode(F.array(free)))
        return x.withColumn("_gone", F.coalesce(~F.col("_free"), F.lit(False))).withColumn("_whole", F.coalesce("_free", F.lit(False))).drop("_free")

    def edges(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: once(F.struct(F.get(ring, i).alias("a"), F.get(ring, F.pmod(i + 1, n)).alias("b")), lambda s: F.struct(
            s["a"]["lon"].alias("ax"), s["a"]["lat"].alias("ay"), s["b"]["lon"].alias("bx"), s["b"]["lat"].alias("by"))))

    real = F.filter("rings", lambda ring: F.size(ring) >= 3)
    x = p.withColumn("rings", real).where(F.size("rings") > 0).withColumn("_edges", F.flatten(F.transform("rings", edges)))
    extent = lambda f, g, a, b: f(F.transform("_edges", lambda e: g(e[a], e[b])))
    x = x.withColumns({"w": extent(F.array_min, F.least, "ax", "bx"), "s": extent(F.array_min, F.least, "ay", "by"), "e": extent(F.array_max, F.greatest, "ax", "bx"), "n": extent(F.array_max, F.greatest, "ay", "by")})
    x = _descended(x, grid, level, looked)
    x = x.withColumn("dggid", grid.cell_id(F.col("at.l"), F.col("at.q"), F.col("at.r"))).withColumn("cell_level", F.col("at.l"))
    # centres that an edge goes through, or nearly: by the same test as everywhere
    x = x.withColumn("_c", F.explode(F.array(grid.centroid(F.col("dggid")))))
    exact = F.aggregate("rings", F.lit(0), lambda k, ring: k + in_ring(F.col("_c.lon"), F.col("_c.lat"), ring).cast("int")) % 2 == 1
    return x.where((F.col("cell_level") < level) | exact).select(*p.columns, "dggid", "cell_level")


def expanded(cover: DataFrame, grid: HexLattice, level: int) -> DataFrame:
    """The cells of `level` that a cover stands for."""
    x = cover
    for k in range(level):
        x = x.withColumn("dggid", F.explode(F.when(F.col("cell_level") == k, grid.children(F.col("dggid"))).otherwise(F.array("dggid"))))
        x = x.withColumn("cell_level", F.when(F.col("cell_level") == k, k + 1).otherwise(F.col("cell_level")))
    return x


def cells_of(level: int) -> Column:
    """How many cells of `level` a cover stands for, without naming them: an aggregate over its rows."""
    return F.sum(F.pow(F.lit(3.0), level - F.col("cell_level")).cast("bigint"))
