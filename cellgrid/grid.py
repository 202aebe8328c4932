"""A planar hexagon lattice of aperture 3 with axial coordinates, as column expressions; and the same interface over tables.

Level L - 1 cells have three children each. Ids are C{level}-{q}-{r}, with n before the digits of a negative number. The
lattice covers the plane of an equal-area cylindrical projection; a cell at level L has the size s * 3^(-L/2).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def once(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


OFFSETS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))
RADIUS_DEG = 180 / math.pi


@dataclass(frozen=True)
class HexLattice:
    """Zones of all levels; `size` is the hexagon's circumradius at level 0, in degrees of the projected plane."""

    size: float = 30.0

    def cell_id(self, level: Column | int, q: Column, r: Column) -> Column:
        level = F.lit(level) if isinstance(level, int) else level
        part = lambda x: F.concat(F.when(x < 0, "n").otherwise(""), F.abs(x).cast("string"))
        return F.concat(F.lit("C"), level.cast("string"), F.lit("-"), part(q), F.lit("-"), part(r))

    def parse(self, dggid: Column) -> Column:
        """struct(level, q, r); null for ids of another form."""
        ok = dggid.rlike(r"^C\d+-n?\d+-n?\d+$")
        number = lambda k: F.regexp_replace(F.split(dggid, "-")[k], "n", "-").try_cast("bigint")
        return F.when(ok, F.struct(F.substring(F.split(dggid, "-")[0], 2, 9).try_cast("int").alias("level"), number(1).alias("q"), number(2).alias("r")))

    def level(self, dggid: Column) -> Column:
        return self.parse(dggid)["level"]

    def parent_qr(self, q: Column, r: Column) -> tuple[Column, Column]:
        c = F.pmod(q - r, F.lit(3))
        q2 = F.when(c == 1, q - 1).when(c == 2, q + 1).otherwise(q)
        return ((q2 - r) / 3).cast("bigint"), ((q2 + 2 * r) / 3).cast("bigint")

    def parent(self, dggid: Column) -> Column:
        """The parent's id; null at level 0 and for foreign ids."""
        return once(self.parse(dggid), lambda p: F.when(p["level"] > 0, self.cell_id(p["level"] - 1, *self.parent_qr(p["q"], p["r"]))))

    def parent_at_level(self, dggid: Column, level: int, from_level: int) -> Column:
        """The ancestor at `level` of a cell of `from_level`."""
        for _ in range(from_level - level):
            dggid = self.parent(dggid)
        return dggid

    def children(self, dggid: Column) -> Column:
        """The three children's ids, the middle one first."""
        return once(self.parse(dggid), lambda p: F.array(*[self.cell_id(p["level"] + 1, 2 * p["q"] + p["r"] + d, p["r"] - p["q"]) for d in (0, 1, -1)]))

    def neighbors(self, dggid: Column) -> Column:
        return once(self.parse(dggid), lambda p: F.array(*[self.cell_id(p["level"], p["q"] + dq, p["r"] + dr) for dq, dr in OFFSETS]))

    def distance(self, a: Column, b: Column) -> Column:
        """Steps between two cells of one level."""
        def steps(x: Column, y: Column) -> Column:
            dq, dr = x["q"] - y["q"], x["r"] - y["r"]
            return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("bigint")

        return once(self.parse(a), lambda x: once(self.parse(b), lambda y: steps(x, y)))

    def _scale(self, level: Column | int) -> Column:
        level = F.lit(level) if isinstance(level, int) else level
        return F.lit(self.size) * F.pow(F.lit(3.0), -level / 2)

    def _turn(self, level: Column | int) -> Column:
        """How far a level's axes are turned: each step of aperture 3 turns them by 30 degrees."""
        level = F.lit(level) if isinstance(level, int) else level
        return level * F.lit(math.pi / 6)

    def centroid(self, dggid: Column) -> Column:
        """struct(lon, lat) of a cell's centre."""
        return once(self.parse(dggid), lambda p: self._point(p, 0.0, 0.0))

    def _point(self, p: Column, dx: float, dy: float) -> Column:
        """struct(lon, lat) at an offset from a cell's centre, in circumradii along the cell's own axes."""
        s, t = self._scale(p["level"]), self._turn(p["level"])
        x0, y0 = s * (math.sqrt(3) * (p["q"] + p["r"] / 2) + dx), s * (1.5 * p["r"] + dy)
        x, y = x0 * F.cos(t) - y0 * F.sin(t), x0 * F.sin(t) + y0 * F.cos(t)
        return F.struct(x.alias("lon"), (F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / RADIUS_DEG))) * RADIUS_DEG).alias("lat"))

    def vertices(self, dggid: Column) -> Column:
        """The closed ring of a cell's corners as array of struct(lon, lat)."""
        corners = [math.pi * (2 * k + 1) / 6 for k in range(7)]
        return once(self.parse(dggid), lambda p: F.array(*[self._point(p, math.cos(a), math.sin(a)) for a in corners]))

    def zone_at_point(self, lon: Column, lat: Column, level: Column | int) -> Column:
        """The id of the cell that holds a point, by rounding cube coordinates."""
        s, t = self._scale(level), self._turn(level)
        x0, y0 = lon, F.sin(F.radians(lat)) * RADIUS_DEG
        x, y = x0 * F.cos(t) + y0 * F.sin(t), -x0 * F.sin(t) + y0 * F.cos(t)

        def rounded(p: Column) -> Column:
            q, r = p["q"], p["r"]
            rq, rr, rs = F.rint(q), F.rint(r), F.rint(-q - r)
            dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
            q1 = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
            r1 = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
            return F.struct(q1.cast("bigint").alias("q"), r1.cast("bigint").alias("r"))

        at = F.struct(((x * math.sqrt(3) / 3 - y / 3) / s).alias("q"), (y * 2 / 3 / s).alias("r"))
        return once(once(at, rounded), lambda c: self.cell_id(level, c["q"], c["r"]))

    def list_zones(self, spark: SparkSession, level: int, west: float, south: float, east: float, north: float, limit: int | None = None) -> DataFrame:
        """Cells whose centre is in the box, by id; `limit` cuts after ordering."""
        if not 0 <= level <= 20:
            raise ValueError("level must be from 0 to 20")
        s, t = self.size * 3 ** (-level / 2), level * math.pi / 6
        corners = [(x, math.sin(math.radians(y)) * RADIUS_DEG) for x in (west, east) for y in (south, north)]
        turned = [(x * math.cos(t) + y * math.sin(t), -x * math.sin(t) + y * math.cos(t)) for x, y in corners]
        qs, rs = [(x * math.sqrt(3) / 3 - y / 3) / s for x, y in turned], [y * 2 / 3 / s for _, y in turned]
        q0, q1, r0, r1 = math.floor(min(qs)) - 1, math.ceil(max(qs)) + 1, math.floor(min(rs)) - 1, math.ceil(max(rs)) + 1
        cells = spark.range(q0, q1 + 1).withColumnRenamed("id", "q").select("q", F.explode(F.sequence(F.lit(r0).cast("bigint"), F.lit(r1).cast("bigint"))).alias("r"))
        z = cells.select(self.cell_id(level, F.col("q"), F.col("r")).alias("dggid")).withColumn("c", self.centroid(F.col("dggid")))
        z = z.where((F.col("c.lon") >= west) & (F.col("c.lon") <= east) & (F.col("c.lat") >= south) & (F.col("c.lat") <= north)).select("dggid", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"))
        return z if limit is None else z.orderBy("dggid").limit(limit)

    def level_for_viewport(self, spark: SparkSession, level: int, box: tuple[float, float, float, float], most: int) -> int:
        """The finest level up to `level` at which the box holds at most `most` cells (1 if there is none).

        A cell's area gives the number closely: levels far above `most` are passed over without a job, the others are counted.
        """
        w, s, e, n = box
        area = (e - w) * (math.sin(math.radians(n)) - math.sin(math.radians(s))) * RADIUS_DEG
        while level > 1:
            about = area / (1.5 * math.sqrt(3) * self.size**2 * 3.0**-level)
            if about <= 4 * most + 100 and self.list_zones(spark, level, *box).limit(most + 1).count() <= most:
                break
            level -= 1
        return level

    def topology(self, cells: DataFrame) -> DataFrame:
        """The adjacency of the given cells (dggid) with each one's parent and level; cells without neighbours have no row."""
        near = cells.select("dggid", F.explode(self.neighbors(F.col("dggid"))).alias("neighbor_dggid"))
        near = near.join(cells.select(F.col("dggid").alias("neighbor_dggid")), "neighbor_dggid", "left_semi")
        return near.select("dggid", "neighbor_dggid", self.parent(F.col("dggid")).alias("parent_dggid"), self.level(F.col("dggid")).alias("level"))


@dataclass(frozen=True)
class TableGrid:
    """The same questions answered from tables of a real grid: topology, centroids (dggid, lon, lat) and rings (dggid, ring)."""

    topology_table: DataFrame
    centroids: DataFrame | None = None
    rings: DataFrame | None = None

    def neighbors(self, cells: DataFrame) -> DataFrame:
        return cells.select("dggid").join(self.topology_table, "dggid").select("dggid", "neighbor_dggid").distinct()

    def parents(self, cells: DataFrame) -> DataFrame:
        return cells.select("dggid").join(self.topology_table, "dggid").select("dggid", "parent_dggid").where("parent_dggid is not null").distinct()

    def children(self, cells: DataFrame) -> DataFrame:
        up = self.topology_table.select(F.col("parent_dggid").alias("dggid"), F.col("dggid").alias("child_dggid")).distinct()
        return cells.select("dggid").join(up, "dggid")

    def centroid(self, cells: DataFrame) -> DataFrame:
        if self.centroids is None:
            raise ValueError("this grid has no centroids")
        return cells.join(self.centroids, "dggid")

    def vertices(self, cells: DataFrame) -> DataFrame:
        if self.rings is None:
            raise ValueError("this grid has no rings")
        return cells.join(self.rings, "dggid")
