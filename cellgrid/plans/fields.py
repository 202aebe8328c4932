"""Queries of rasters, covers, geostatistics and series, and of the fixed tables (levels, permissions, services) joined with given rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import access, ml
from ..grid import HexLattice
from ..operators import automata, geometry, geostat, series, temporal
from ..session import cut
from ..sources import cover, geotiff, rasters, vectors
from .fixtures import Fixtures
from .registry import add, rounded

LATTICE = HexLattice()
_ID = (
    "'C{l}-' || CASE WHEN q < 0 THEN 'n' ELSE '' END || CAST(abs(q) AS VARCHAR) || '-' "
    "|| CASE WHEN r < 0 THEN 'n' ELSE '' END || CAST(abs(r) AS VARCHAR)"
)


def _lattice(level: int, reach: int) -> str:
    """SQL of all zones (dggid, lon, lat) of a level on the globe."""
    scale, turn = f"30.0::DOUBLE * pow(3.0::DOUBLE, {-level / 2}::DOUBLE)", f"pi() * {level} / 6"
    return f"""
        lattice AS (SELECT a.v AS q, b.v AS r FROM range({-reach}, {reach + 1}) a(v), range({-reach}, {reach + 1}) b(v)),
        plane AS (SELECT q, r, {scale} * sqrt(3.0::DOUBLE) * (q + r / 2.0::DOUBLE) x, {scale} * 1.5::DOUBLE * r y FROM lattice),
        turned AS (SELECT q, r, x * cos({turn}) - y * sin({turn}) lon, radians(x * sin({turn}) + y * cos({turn})) h FROM plane),
        zones AS (SELECT {_ID.format(l=level)} AS dggid, lon, degrees(asin(h)) lat FROM turned WHERE abs(h) < 1 AND abs(lon) < 200)
    """


# -- rasters
def _tiles(f: Fixtures, compression: int) -> tuple[DataFrame, DataFrame]:
    """The parts' prices as GeoTIFF files of 32 by 32 pixels, and the centres of the parts' cells."""
    rows = f.grid().agg(F.max("r")).first()[0] + 1
    pixels = f.grid().join(f.elev().select("dggid", "value_num"), "dggid").select(F.col("r").alias("row"), F.col("q").alias("col"), F.col("value_num").alias("value"))
    files = geotiff.tiles(pixels, rasters.Raster(0.0, 0.0, 1.0, 1.0, rows, 50), 32, compression)
    places = f.grid().select("dggid", (F.col("q") + 0.5).alias("lon"), (-F.col("r") - 0.5).alias("lat"))
    return cut(files, "tiles"), places


_SAMPLED = "SELECT dggid, CAST(7 AS BIGINT) AS tid, 'price' AS attr_key, value_num FROM elev"
add("raster_tiles_lzw", _SAMPLED, lambda f: geotiff.sample_files(*_tiles(f, geotiff.LZW), "price", 7))
add("raster_tiles_packbits", _SAMPLED, lambda f: geotiff.sample_files(*_tiles(f, geotiff.PACKBITS), "price", 7))
add(
    "raster_tile_headers",
    """
        SELECT CAST(r // 32 AS INT) AS tile_row, CAST(q // 32 AS INT) AS tile_col, CAST(q // 32 * 32 AS DOUBLE) AS west,
        CAST(-(r // 32) * 32 AS DOUBLE) AS north, CAST(CASE q // 32 WHEN 0 THEN 32 ELSE 18 END AS INT) AS cols FROM grid GROUP BY ALL
    """,
    lambda f: geotiff.headers_of(_tiles(f, geotiff.DEFLATE)[0]).select(
        F.regexp_extract("path", r"r(\d+)", 1).cast("int").alias("tile_row"), F.regexp_extract("path", r"c(\d+)", 1).cast("int").alias("tile_col"), "west", (F.col("north") + 0.0).alias("north"), "cols"),
)

# -- covers
_BOXES = """
    boxes AS (SELECT n_nationkey AS k, CAST(n_nationkey * 13 % 300 - 150 AS DOUBLE) + 0.123 AS w,
    CAST(n_nationkey * 7 % 120 - 60 AS DOUBLE) + 0.321 AS s FROM nation)
"""
_IN_BOX = "lon BETWEEN w AND w + 17.5 AND lat BETWEEN s AND s + 11.25"


def _boxes(f: Fixtures) -> DataFrame:
    k = F.col("n_nationkey")
    w, s = (k * 13 % 300 - 150).cast("double") + 0.123, (k * 7 % 120 - 60).cast("double") + 0.321
    return f.table("nation").select(k.alias("k"), w.alias("w"), s.alias("s"), (w + 17.5).alias("e"), (s + 11.25).alias("n"))


def _polygons(f: Fixtures) -> DataFrame:
    """The boxes as features whose value is their number."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    value = F.create_map(F.lit("v"), F.col("k").cast("string"))
    return _boxes(f).select(F.col("k").cast("bigint").alias("feature_no"), F.lit("Polygon").alias("kind"), F.to_json(F.array(ring)).alias("coordinates"), value.alias("properties"))


add(
    "burn_boxes",
    f"""
        WITH {_lattice(4, 50)}, {_BOXES} SELECT dggid, CAST(0 AS BIGINT) AS tid, 'v' AS attr_key,
        CAST(MAX(k) AS DOUBLE) AS value_num FROM zones JOIN boxes ON {_IN_BOX} GROUP BY dggid
    """,
    lambda f: vectors.burn(_polygons(f), LATTICE, 4, "v"),
)
add(
    "cover_counts",
    f"""
        WITH {_lattice(5, 90)}, {_BOXES} SELECT CAST(k AS BIGINT) AS k, COUNT(*) AS cells FROM zones JOIN boxes ON {_IN_BOX} GROUP BY k
    """,
    lambda f: cover.cover_boxes(_boxes(f), LATTICE, 5).groupBy(F.col("k").cast("bigint").alias("k")).agg(cover.cells_of(5).alias("cells")),
)
add(
    "zones_in_box",
    f"""
        WITH {_lattice(3, 40)}, {_BOXES} SELECT CAST(k AS BIGINT) AS k, dggid, ROUND(lon, 5) + 0.0::DOUBLE AS lon,
        ROUND(lat, 5) + 0.0::DOUBLE AS lat FROM zones JOIN boxes ON {_IN_BOX}
    """,
    lambda f: rounded(vectors.cells_in_boxes(_boxes(f), LATTICE, 3).select(F.col("k").cast("bigint").alias("k"), "dggid", "lon", "lat"), "lon", "lat", digits=5).withColumns({n: F.col(n) + 0.0 for n in ("lon", "lat")}),
)
_CUBE_ROUND = """
    points AS (SELECT event_id, CAST(user_id % 300 - 150 AS DOUBLE) + 0.237 AS x0,
    sin(radians(CAST(event_id % 120 - 60 AS DOUBLE) + 0.411)) * 180 / pi() AS y0 FROM events),
    axial AS (SELECT event_id, (y0 * sqrt(3.0::DOUBLE) / 3 + x0 / 3) / sc AS fq, -x0 * 2 / 3 / sc AS fr
    FROM points, (SELECT 30.0::DOUBLE * pow(3.0::DOUBLE, -1.5::DOUBLE) AS sc)),
    near_by AS (SELECT *, round(fq) rq, round(fr) rr, round(-fq - fr) rs FROM axial),
    off_by AS (SELECT *, abs(rq - fq) dq, abs(rr - fr) dr, abs(rs + fq + fr) ds FROM near_by),
    cells AS (SELECT event_id, CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q,
    CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM off_by)
"""
add(
    "zone_at_point",
    f"WITH {_CUBE_ROUND} SELECT event_id, {_ID.format(l=3)} AS dggid FROM cells",
    lambda f: f.table("events").select("event_id", LATTICE.zone_at_point((F.col("user_id") % 300 - 150).cast("double") + 0.237, (F.col("event_id") % 120 - 60).cast("double") + 0.411, 3).alias("dggid")),
)

# -- geostatistics
_PLACES = "places AS (SELECT dggid, q, r, sqrt(3.0::DOUBLE) * (q + r / 2.0::DOUBLE) AS x, 1.5::DOUBLE * r AS y FROM grid)"
_MODEL = geostat.Variogram(0.5, 10.0, 8.0)
_GAMMA = "CASE WHEN {d} > 0 THEN 0.5 + 9.5 * (1 - exp(-3 * ({d} / 8.0))) ELSE 0 END"


def _places(f: Fixtures) -> DataFrame:
    return f.grid().select("dggid", (F.sqrt(F.lit(3.0)) * (F.col("q") + F.col("r") / 2)).alias("x"), (F.col("r") * 1.5).alias("y"))


add(
    "variogram",
    f"""
        WITH {_PLACES}, m AS (SELECT dggid, q, r, x, y, value_num v FROM q97 JOIN places USING (dggid)),
        p AS (SELECT a.v v, b.v w, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d FROM m a JOIN m b
        ON b.q BETWEEN a.q - 6 AND a.q + 6 AND b.r BETWEEN a.r - 3 AND a.r + 3 AND a.dggid < b.dggid)
        SELECT CAST(floor(d / 0.9) AS BIGINT) AS bin, ROUND(AVG(d), 6) AS distance, COUNT(*) AS pairs,
        ROUND(AVG((v - w) * (v - w) / 2), 4) AS semivariance FROM p WHERE d <= 4.1 GROUP BY 1
    """,
    lambda f: rounded(rounded(geostat.variogram(f.year(1997), _places(f), 4.1, 0.9), "distance"), "semivariance", digits=4),
)
add(
    "kriging_two_nearest",
    f"""
        WITH {_PLACES}, m AS (SELECT dggid, q, r, x, y, value_num v FROM q97 JOIN places USING (dggid)),
        p AS (SELECT t.dggid, m.x, m.y, m.v, sqrt((t.x - m.x) * (t.x - m.x) + (t.y - m.y) * (t.y - m.y)) d, m.dggid source
        FROM places t JOIN m ON m.q BETWEEN t.q - 5 AND t.q + 5 AND m.r BETWEEN t.r - 2 AND t.r + 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY dggid ORDER BY d, source) n FROM p WHERE d <= 3.1),
        two AS (SELECT a.dggid, a.v va, b.v vb, {_GAMMA.format(d='a.d')} ga, {_GAMMA.format(d='b.d')} gb,
        {_GAMMA.format(d='sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')} g
        FROM k a LEFT JOIN k b ON b.dggid = a.dggid AND b.n = 2 WHERE a.n = 1),
        w AS (SELECT *, CASE WHEN vb IS NULL THEN 1 ELSE 0.5 + (gb - ga) / (2 * g) END wa FROM two)
        SELECT dggid, ROUND(CASE WHEN vb IS NULL THEN va ELSE wa * va + (1 - wa) * vb END, 5) AS value_num,
        ROUND(greatest(0, CASE WHEN vb IS NULL THEN 2 * ga ELSE wa * ga + (1 - wa) * gb + ga - (1 - wa) * g END), 5) + 0.0::DOUBLE AS variance,
        CASE WHEN vb IS NULL THEN 1 ELSE 2 END::BIGINT AS sources FROM w
    """,
    lambda f: rounded(geostat.krige(f.year(1997), f.grid().select("dggid"), _places(f), _MODEL, 3.1, 2), "value_num", "variance", digits=5).withColumn("variance", F.col("variance") + 0.0),
)


def _kriged(f: Fixtures) -> DataFrame:
    values, places = f.year(1997), _places(f)
    model = geostat.fitted(geostat.variogram(values, places, 8.0, 1.0))
    return geostat.krige(values, f.grid().select("dggid"), places, model, 8.0)


add("kriging", None, _kriged)

add(
    "local_outliers",
    f"""
        WITH {_PLACES}, m AS (SELECT dggid, x, y, value_num v FROM q97 JOIN places USING (dggid)),
        p AS (SELECT a.dggid, b.dggid source, sqrt(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))
        + 0.05::DOUBLE * (b.v - a.v) * (0.05::DOUBLE * (b.v - a.v))) d FROM m a JOIN m b ON a.dggid != b.dggid),
        k AS (SELECT *, row_number() OVER (PARTITION BY dggid ORDER BY d, source) nth FROM p),
        far AS (SELECT dggid, d reach FROM k WHERE nth = 5), n AS (SELECT k.dggid, source, d, reach FROM k JOIN far USING (dggid) WHERE d <= reach),
        l AS (SELECT n.dggid, 1 / AVG(greatest(n.d, o.reach)) density, COUNT(*) neighbors FROM n JOIN far o ON o.dggid = n.source GROUP BY 1),
        t AS (SELECT n.dggid, AVG(l.density) theirs FROM n JOIN l ON l.dggid = n.source GROUP BY 1)
        SELECT dggid, neighbors, ROUND(density, 6) AS density, ROUND(theirs / density, 6) AS lof FROM l JOIN t USING (dggid)
    """,
    lambda f: rounded(geostat.local_outliers(f.year(1997), _places(f), 5, 0.05), "density", "lof"),
)


def _covariates(f: Fixtures) -> DataFrame:
    return f.year(1997).select("dggid", F.col("value_num").alias("y")).join(f.elev().select("dggid", F.col("value_num").alias("x")), "dggid")


add(
    "spatial_lag_model",
    """
        WITH m AS (SELECT q97.dggid, q97.value_num y, elev.value_num x FROM q97 JOIN elev USING (dggid)),
        w AS (SELECT t.dggid, AVG(n.y) wy, AVG(n.x) wx FROM topo t JOIN m n ON n.dggid = t.neighbor_dggid GROUP BY 1),
        z AS (SELECT m.*, coalesce(wy, 0) wy, coalesce(wx, 0) wx FROM m LEFT JOIN w USING (dggid)),
        c AS (SELECT covar_pop(x, wy) a, covar_pop(x, x) b, covar_pop(x, y) g, covar_pop(wx, wy) d, covar_pop(wx, x) e,
        covar_pop(wx, y) h FROM z)
        SELECT unnest(['rho', 'x']) AS term, ROUND(unnest([(g * e - b * h) / (a * e - b * d), (a * h - d * g) / (a * e - b * d)]), 3) AS estimate FROM c
    """,
    lambda f: rounded(geostat.spatial_lag_model(_covariates(f), f.topo(), "y", ["x"], 1).where("term != 'const'").select("term", "estimate"), "estimate", digits=3),
)
add("spatial_error_model", None, lambda f: geostat.spatial_error_model(_covariates(f), f.topo(), "y", ["x"]))

# -- series
add(
    "mann_kendall",
    """
        WITH p AS (SELECT a.dggid, a.attr_key, sign(b.value_num - a.value_num) s, (b.value_num - a.value_num) / (b.tid - a.tid) m
        FROM qty a JOIN qty b ON b.dggid = a.dggid AND b.tid > a.tid),
        s AS (SELECT dggid, attr_key, CAST(SUM(s) AS BIGINT) s, median(m) slope FROM p GROUP BY 1, 2),
        t AS (SELECT dggid, attr_key, value_num, COUNT(*) k FROM qty GROUP BY ALL),
        v AS (SELECT dggid, attr_key, SUM(k) n, SUM(k * (k - 1) * (2 * k + 5)) ties FROM t GROUP BY 1, 2),
        z AS (SELECT *, CAST(n AS BIGINT) AS points, (n * (n - 1) * (2 * n + 5) - ties) / 18.0::DOUBLE AS variance FROM s JOIN v USING (dggid, attr_key)),
        y AS (SELECT *, CASE WHEN variance > 0 THEN (s - sign(s)) / sqrt(variance) ELSE 0 END AS z FROM z)
        SELECT dggid, attr_key, points, s, ROUND(variance, 6) AS variance, ROUND(z, 6) + 0.0::DOUBLE AS z, ROUND(2 * s / (points * (points - 1))::DOUBLE, 6) + 0.0::DOUBLE AS tau,
        ROUND(slope, 6) + 0.0::DOUBLE AS slope, CASE WHEN z > 1.96 THEN 'up' WHEN z < -1.96 THEN 'down' ELSE 'none' END AS trend FROM y
    """,
    lambda f: rounded(series.mann_kendall(f.qty()), "variance", "z", "tau", "slope").withColumns({n: F.col(n) + 0.0 for n in ("z", "tau", "slope")}),
)
add("seasonal_decomposition", None, lambda f: series.decompose(f.qty(), 3))

add(
    "playback_next",
    "SELECT event_id, (tid + 1) % 201 AS shown FROM evt",
    lambda f: f.evt().select("event_id", temporal.next_tid(F.col("tid"), 200).alias("shown")),
)

# -- automata and topology
_reached = "WITH w AS (SELECT dggid FROM grid WHERE k % 211 = 0 UNION SELECT t.neighbor_dggid FROM w JOIN topo t ON t.dggid = w.dggid)"
add(
    "ca_run_no_changes",
    f"{_reached} SELECT grid.dggid, CASE WHEN w.dggid IS NULL THEN 'unburned' ELSE 'burned' END AS state FROM grid LEFT JOIN w ON w.dggid = grid.dggid",
    lambda f: automata.run(
        f.grid().select("dggid", F.when(F.col("k") % 211 == 0, "burning").otherwise("unburned").alias("state")), f.topo(), 100, stop="no_changes"),
)
add(
    "topology_of_cells",
    "SELECT t.dggid, t.neighbor_dggid, p.parent_dggid, 3 AS level FROM topo t JOIN parent p ON p.dggid = t.dggid",
    lambda f: LATTICE.topology(f.grid().select("dggid")),
)

# -- fixed tables beside given rows
add(
    "temporal_hierarchy",
    """
        WITH l AS (SELECT i, ['instantaneous', 'minutely', 'hourly', 'daily', 'weekly', 'monthly', 'yearly', 'decade', 'century', 'millennium'][i + 1] AS n,
        ['Single moment in time, no aggregation', 'Data aggregated to minute-level resolution', 'Data aggregated to hourly resolution',
        'Data aggregated to daily resolution', 'Data aggregated to weekly resolution', 'Data aggregated to monthly resolution',
        'Data aggregated to yearly resolution', 'Data aggregated to decade-level resolution', 'Data aggregated to century-level resolution',
        'Data aggregated to millennium-level resolution'][i + 1] AS d FROM range(0, 10) r(i))
        SELECT CAST(i AS INT) AS level, n AS name, d AS description, COUNT(*) AS readings FROM events JOIN l ON i = event_id % 10 GROUP BY ALL
    """,
    lambda f: f.table("events").groupBy((F.col("event_id") % 10).cast("int").alias("level")).agg(F.count("*").alias("readings")).join(temporal.hierarchy(f.spark), "level").select("level", "name", "description", "readings"),
)
add(
    "role_permissions",
    """
        WITH p AS (SELECT 'admin' AS role,
        unnest(['create_dataset', 'edit_any_dataset', 'delete_any_dataset', 'create_user', 'edit_user',
        'delete_user', 'manage_system', 'view_any_dataset', 'run_any_operation', 'delete_any_operation']) AS permission
        UNION ALL SELECT 'editor',
        unnest(['create_dataset', 'edit_own_dataset', 'delete_own_dataset', 'view_any_dataset', 'run_any_operation'])
        UNION ALL SELECT 'viewer', unnest(['view_own_dataset', 'view_any_dataset']))
        SELECT c_custkey AS user_no, role, permission FROM customer JOIN p ON role = ['viewer', 'editor', 'admin'][c_custkey % 3 + 1]
    """,
    lambda f: f.table("customer").select(F.col("c_custkey").alias("user_no"), F.element_at(F.array(*map(F.lit, ("viewer", "editor", "admin"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("role"))
    .join(access.role_permissions(f.spark), "role").select("user_no", "role", "permission"),
)
add(
    "services",
    "SELECT dggid, 'fire-spread' AS id, 'ANALYTIC' AS kind FROM mask",
    lambda f: f.mask().join(ml.services(f.spark).select("id", "kind"), F.lit(True)),
)
_REGIONS = rasters.DEMO_LAYERS[0]
add(
    "demo_layer_regions",
    f"""
        WITH {_lattice(2, 40)}, d AS (SELECT dggid FROM zones WHERE lon BETWEEN -140 AND 140 AND lat BETWEEN -70 AND 70 UNION ALL SELECT dggid FROM grid),
        u AS (SELECT dggid, CAST(('0x' || md5('region:' || dggid)[1:8]) AS BIGINT) % 1000000 / 1000000.0::DOUBLE AS u FROM d)
        SELECT dggid, CAST(0 AS BIGINT) AS tid, 'region' AS attr_key, CASE WHEN u < 0.4 THEN 'region_a'
        WHEN u < 0.75 THEN 'region_b' ELSE 'region_c' END AS value_text FROM u
    """,
    lambda f: rasters.demo_layer(f.spark, LATTICE, _REGIONS).unionByName(rasters.synthetic(f.grid().select("dggid"), _REGIONS.key, _REGIONS.classes)),
)
add(
    "durations_year",
    """
        SELECT o_orderkey, CAST(year(o_orderdate) - 1000 AS BIGINT) AS tid, 'YEAR' AS unit, CAST(date_trunc('year', o_orderdate)::DATE AS VARCHAR) AS begins,
        CAST(make_date(year(o_orderdate) + 1, 1, 1) AS VARCHAR) AS ends FROM orders
    """,
    lambda f: f.table("orders").select("o_orderkey", (F.year("o_orderdate") - 1000).cast("bigint").alias("tid")).join(geometry.durations(f.spark), "tid")
    .select("o_orderkey", "tid", "unit", F.col("begins").cast("string").alias("begins"), F.col("ends").cast("string").alias("ends")),
)
