"""Queries of what surrounds the operators.

Roll-ups of cubes, copies, rows by key, sources and sinks, the catalogue, access, scenes, models and streams.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import access, catalog, ml
from ..functions.values import typed_value
from ..grid import HexLattice
from ..operators import automata, geometry, neighborhood, query, reach, rollup, temporal, zonal
from ..session import work_dir
from ..sources import rasters, sinks, stac, tables
from ..streaming import cells as streams
from .fixtures import Fixtures
from .registry import add, rounded

LATTICE = HexLattice()
CELL = ("dggid", "tid", "attr_key", "value_num")
_ID = (
    "'C{l}-' || CASE WHEN {q} < 0 THEN 'n' ELSE '' END || CAST(abs({q}) AS VARCHAR) || '-' "
    "|| CASE WHEN {r} < 0 THEN 'n' ELSE '' END || CAST(abs({r}) AS VARCHAR)"
)
_UP = "CASE ((q-r)%3+3)%3 WHEN 1 THEN q-1 WHEN 2 THEN q+1 ELSE q END"
_CUBE = "cube AS (SELECT * FROM qty UNION ALL SELECT * FROM price)"
_cube = lambda f: f.qty().unionByName(f.price())


def _brands(f: Fixtures) -> DataFrame:
    """Each cell's brand as a text attribute."""
    tid, key = F.lit(0).cast("bigint").alias("tid"), F.lit("brand").alias("attr_key")
    number = F.lit(None).cast("double").alias("value_num")
    return f.zone().select("dggid", tid, key, F.col("zone_id").alias("value_text"), number)



# -- roll-ups of cubes: attributes and times stay apart
for _how, _f in (("mean", "AVG"), ("sum", "SUM"), ("min", "MIN"), ("max", "MAX"), ("count", "COUNT")):
    add(
        f"cube_rollup_{_how}",
        f"""
            WITH {_CUBE}
            SELECT parent_dggid AS dggid, tid, attr_key, ROUND(CAST({_f}(value_num) AS DOUBLE), 6) AS value_num
            FROM cube JOIN parent USING (dggid) GROUP BY 1, 2, 3
        """,
        lambda f, how=_how: rounded(rollup.cube_rollup(_cube(f), LATTICE.parent, 3, 2, how).select(*CELL), "value_num"),
    )
_L1 = f"""
    l2 AS (SELECT dggid, ({_UP} - r)//3 AS q, ({_UP} + 2*r)//3 AS r
    FROM grid), l1 AS (SELECT dggid, ({_UP} - r)//3 AS q, ({_UP} + 2*r)//3 AS r
    FROM l2), up2 AS (SELECT dggid AS below, {_ID.format(l=1, q='q', r='r')} AS above FROM l1)
"""
add(
    "cube_rollup_two_levels",
    f"""
        WITH {_CUBE}, {_L1} SELECT above AS dggid, tid, attr_key, ROUND(SUM(value_num), 6) AS value_num FROM cube
        JOIN up2 ON below = dggid GROUP BY 1, 2, 3
    """,
    lambda f: rounded(rollup.cube_rollup(_cube(f), LATTICE.parent, 3, 1, "sum").select(*CELL), "value_num"),
)
add(
    "cube_mode_two_levels",
    f"""
        WITH {_L1} SELECT dggid, CAST(0 AS BIGINT) AS tid, 'brand' AS attr_key, value_text
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dggid ORDER BY n DESC, value_text) AS k
        FROM (SELECT above AS dggid, zone_id AS value_text, COUNT(*) AS n FROM zone JOIN up2 ON below = dggid
        GROUP BY 1, 2)) WHERE k = 1
    """,
    lambda f: rollup.cube_rollup(_brands(f), LATTICE.parent, 3, 1, "mode").drop("value_num"),
)
add(
    "cells_rollup_topology",
    f"""
        WITH {_CUBE} SELECT parent_dggid AS dggid, tid, attr_key, ROUND(SUM(value_num), 6) AS value_num FROM cube
        JOIN parent USING (dggid) GROUP BY 1, 2, 3
    """,
    lambda f: rounded(rollup.rollup_cells(_cube(f), f.topo().join(f.parent(), "dggid"), "sum").select(*CELL), "value_num"),
)
add(
    "optimised_focal_mean",
    "SELECT dggid, ROUND(AVG(v_n), 6) AS focal_mean, COUNT(*) AS neighbor_count FROM nb GROUP BY 1",
    lambda f: rounded(
        neighborhood.focal_mean(catalog.optimised(f.year(1997), "mv_q97"), catalog.optimised(f.topo(), "mv_topo")),
        "focal_mean",
    ),
)
add(
    "aggregated_copy_mean",
    f"""
        WITH {_CUBE}
        SELECT parent_dggid AS dggid, CAST(0 AS BIGINT) AS tid, attr_key, ROUND(AVG(value_num), 6) AS value_num
        FROM cube JOIN parent USING (dggid) GROUP BY 1, 3
    """,
    lambda f: rounded(catalog.aggregated_copy(_cube(f), f.parent(), 3, 2).select(*CELL), "value_num"),
)

# -- rows by key
_KEY = {"dggid": "C3-7-1", "tid": 1997, "attr_key": "quantity"}
_IS = "dggid = 'C3-7-1' AND tid = 1997 AND attr_key = 'quantity'"
add(
    "row_get",
    f"WITH {_CUBE} SELECT dggid, tid, attr_key, value_num FROM cube WHERE {_IS}",
    lambda f: tables.get_row(_cube(f), _KEY).select(*CELL),
)
add(
    "row_update",
    f"WITH {_CUBE} SELECT dggid, tid, attr_key, CASE WHEN {_IS} THEN -1.0 ELSE value_num END::DOUBLE AS value_num FROM cube",
    lambda f: tables.update_row(_cube(f), _KEY, {"value_num": -1}).select(*CELL),
)
add(
    "row_delete",
    f"WITH {_CUBE} SELECT dggid, tid, attr_key, value_num FROM cube WHERE NOT ({_IS})",
    lambda f: tables.delete_row(_cube(f), _KEY).select(*CELL),
)

# -- top-k, ordered by what was computed before it is rounded
add(
    "change_top20",
    """
        SELECT * FROM (SELECT COALESCE(a.dggid, b.dggid) AS dggid,
        COALESCE(b.value_num, 0) - COALESCE(a.value_num, 0) AS abs_change FROM q97 a FULL
        JOIN q98 b ON a.dggid = b.dggid WHERE a.value_num IS DISTINCT FROM b.value_num)
        ORDER BY abs(abs_change) DESC, dggid LIMIT 20
    """,
    lambda f: neighborhood.change(f.year(1997), f.year(1998), limit=20).select("dggid", "abs_change"),
)
add(
    "hotspot_top25",
    """WITH x AS (SELECT dggid, v, SUM(v_n) s, COUNT(*) k FROM nb GROUP BY 1, 2)
        SELECT dggid, v AS value, ROUND((s - m * k) / (sd * sqrt((n * k - k * k) / (n - 1)::DOUBLE)), 4) AS gi_z FROM x, st
        ORDER BY (s - m * k) / (sd * sqrt((n * k - k * k) / (n - 1)::DOUBLE)) DESC, dggid LIMIT 25""",
    lambda f: neighborhood.hotspots(f.year(1997), f.topo(), limit=25).select("dggid", "value", "gi_z"),
)
add(
    "hotspot_gi_star",
    """
        WITH own AS (SELECT dggid, v, v_n FROM nb UNION ALL SELECT dggid, value_num, value_num
        FROM q97), x AS (SELECT dggid, v, SUM(v_n) s, COUNT(*) k FROM own GROUP BY 1, 2)
        SELECT dggid, v AS value, s AS local_sum, k AS neighbor_count,
        ROUND((s - m * k) / (sd * sqrt((n * k - k * k) / (n - 1)::DOUBLE)), 4) AS gi_z FROM x, st
    """,
    lambda f: neighborhood.hotspots(f.year(1997), f.topo(), include_self=True).select(
        "dggid",
        "value",
        "local_sum",
        "neighbor_count",
        "gi_z",
    ),
)
add(
    "lisa_top25",
    """WITH x AS (SELECT dggid, v, (v - m) / sd z, SUM((v_n - m) / sd) / COUNT(*) lag FROM nb, st GROUP BY dggid, v, m, sd)
        SELECT dggid, v AS value, ROUND(z * lag, 4) AS local_i FROM x ORDER BY abs(z * lag) DESC, dggid LIMIT 25""",
    lambda f: neighborhood.lisa(f.year(1997), f.topo(), limit=25).select("dggid", "value", "local_i"),
)

# -- neighbourhoods, shapes and reach
add(
    "spatial_regression",
    """
        WITH x AS (SELECT dggid, v, AVG(v_n) lag FROM nb GROUP BY 1, 2)
        SELECT COUNT(*) AS n, ROUND(regr_slope(v, lag), 6) AS slope, ROUND(regr_intercept(v, lag), 6) AS intercept,
        ROUND(regr_r2(v, lag), 6) AS r2 FROM x
    """,
    lambda f: rounded(neighborhood.spatial_regression(f.year(1997), f.topo()), "slope", "intercept", "r2"),
)
add(
    "covariogram_r2",
    """
        WITH w AS (SELECT dggid AS src, dggid, 0 AS d FROM q97 UNION SELECT src, t.neighbor_dggid, d + 1 FROM w
        JOIN topo t ON t.dggid = w.dggid WHERE d < 2), s AS (SELECT src, dggid, MIN(d) d FROM w GROUP BY 1, 2)
        SELECT CAST(d AS BIGINT) AS distance, COUNT(*) AS pairs,
        ROUND(AVG((a.value_num - m) * (b.value_num - m)), 4) AS covariance FROM s JOIN q97 a ON a.dggid = s.dggid
        JOIN q97 b ON b.dggid = src, st GROUP BY 1
    """,
    lambda f: rounded(neighborhood.covariogram(f.year(1997), f.topo(), 2), "covariance", digits=4),
)
add(
    "junction_cells",
    """
        WITH z AS (SELECT dggid, zone_id FROM zone UNION SELECT t.dggid, zone_id FROM topo t
        JOIN zone ON zone.dggid = t.neighbor_dggid) SELECT dggid, COUNT(DISTINCT zone_id) AS zones FROM z
        GROUP BY 1 HAVING COUNT(DISTINCT zone_id) >= 7
    """,
    lambda f: neighborhood.junctions(f.zone(), f.topo(), 7),
)
_EDGE = """
    kept AS (SELECT dggid FROM grid WHERE k % 11 <> 0), edge AS (SELECT a.dggid FROM kept a LEFT
    JOIN topo t ON t.dggid = a.dggid LEFT JOIN kept n ON n.dggid = t.neighbor_dggid
    GROUP BY 1 HAVING COUNT(n.dggid) < 6)
"""
_kept = lambda f: f.grid().where("k % 11 <> 0").select("dggid")
add(
    "shrink_1",
    f"WITH {_EDGE} SELECT dggid FROM kept EXCEPT SELECT dggid FROM edge",
    lambda f: reach.shrink(_kept(f), f.topo(), 1),
)
add(
    "shrink_2",
    f"""
        WITH {_EDGE} SELECT dggid FROM kept EXCEPT SELECT dggid FROM edge EXCEPT SELECT neighbor_dggid FROM edge
        JOIN topo USING (dggid)
    """,
    lambda f: reach.shrink(_kept(f), f.topo(), 2),
)
add(
    "buffer_max_cells",
    """WITH seed AS (SELECT dggid FROM grid WHERE k % 97 = 0), reach AS (SELECT dggid, 0 AS d FROM seed UNION
        SELECT t.neighbor_dggid, d + 1 FROM reach r JOIN topo t ON t.dggid = r.dggid WHERE d < 3)
        SELECT dggid FROM (SELECT dggid, MIN(d) d FROM reach GROUP BY 1) ORDER BY d, dggid LIMIT 60""",
    lambda f: reach.buffer(f.every(97), f.topo(), 3, max_cells=60),
)
_VORONOI = """
    w AS (SELECT dggid AS seed, dggid, 0 AS d FROM grid WHERE k % 211 = 0 UNION SELECT w.seed, t.neighbor_dggid, d + 1
    FROM w JOIN topo t ON t.dggid = w.dggid WHERE d < 10), v AS (SELECT dggid, seed, d
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dggid ORDER BY d, seed) k FROM w) WHERE k = 1)
"""
add(
    "voronoi_summary",
    f"WITH {_VORONOI} SELECT seed AS zone_id, COUNT(*) AS cell_count, ROUND(AVG(d), 6) AS avg_distance FROM v GROUP BY 1",
    lambda f: rounded(reach.zone_summary(reach.voronoi(f.every(211), f.topo(), 10)), "avg_distance"),
)
add(
    "viewshed_summary",
    """
        WITH w AS (SELECT 'C3-2-2' AS dggid, 0 AS d UNION SELECT t.neighbor_dggid, d + 1 FROM w
        JOIN topo t ON t.dggid = w.dggid WHERE d < 6), m AS (SELECT dggid, MIN(d) d FROM w
        GROUP BY 1), o AS (SELECT value_num + 1.8::DOUBLE eye FROM elev WHERE dggid = 'C3-2-2') SELECT CASE
        WHEN (value_num - eye) / d > -0.1 THEN 'visible' ELSE 'hidden' END AS visibility, COUNT(*) AS cells FROM m
        JOIN elev USING (dggid), o WHERE d >= 1 GROUP BY 1
    """,
    lambda f: reach.visibility_summary(reach.viewshed(f.elev(), f.topo(), "C3-2-2", 1.8, 6)),
)
add(
    "zonal_mode_pair",
    """
        SELECT tid, value_num, value_text, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tid
        ORDER BY n DESC, value_num, value_text) k FROM (SELECT tid, value_num, attr_key AS value_text, COUNT(*) n
        FROM qty GROUP BY 1, 2, 3)) WHERE k = 1
    """,
    lambda f: zonal.mode(f.qty().withColumn("value_text", F.col("attr_key")), ["tid"], ("value_num", "value_text")),
)
add(
    "zonal_by_zone_expanded",
    f"""
        WITH z AS (SELECT DISTINCT {_ID.format(l=3, q="(2*pq+pr+d)", r="(pr-pq)")} AS dggid, 'C2-' || CASE
        WHEN pq<0 THEN 'n' ELSE '' END || CAST(abs(pq) AS VARCHAR) || '-' || CAST(pr AS VARCHAR) AS zone_id
        FROM pqr, (VALUES (0), (1), (-1)) o(d))
        SELECT zone_id, ROUND(SUM(value_num), 6) AS result, COUNT(value_num) AS count,
        COUNT(DISTINCT z.dggid) AS zone_cells FROM z LEFT JOIN q97 ON q97.dggid = z.dggid GROUP BY 1
    """,
    lambda f: rounded(
        zonal.zonal_by_zone(
            f.year(1997),
            f.parent().select(F.col("parent_dggid").alias("dggid"), F.col("parent_dggid").alias("zone_id")),
            "SUM",
            LATTICE.children,
            1,
        ),
        "result",
    ),
)


def _split(f: Fixtures) -> DataFrame:
    parts = geometry.split_by(f.zone(), "zone_id")
    return parts["Brand#11"].unionByName(parts["Brand#12"])


add("split_by_label", "SELECT dggid, zone_id FROM zone WHERE zone_id IN ('Brand#11', 'Brand#12')", _split)
add(
    "prefix_is_literal",
    "SELECT 'C3_' || CAST(k AS VARCHAR) AS dggid FROM grid WHERE k % 2 = 0",
    lambda f: query.list_cells(
        f.grid().select(
            F.concat(
                F.lit("C3"),
                F.when(F.col("k") % 2 == 0, "_").otherwise("x"),
                F.col("k").cast("string"),
            ).alias("dggid"),
            F.lit(0).alias("tid"),
            F.lit("a").alias("attr_key"),
        ),
        prefix="C3_",
        limit=None,
    ).select("dggid"),
)

# -- time and automata
add(
    "temporal_snapshot_slots",
    """
        SELECT dggid, attr_key, MAX(tid) AS tid, arg_max(value_num,
        tid) AS value_num, 'y' || CAST(MAX(tid) AS VARCHAR) AS value_text FROM qty WHERE tid <= 1997 GROUP BY 1, 2
    """,
    lambda f: temporal.snapshot(
        f.qty().drop("value_json").withColumn("value_text", F.concat(F.lit("y"), F.col("tid").cast("string"))),
        1997,
    ),
)
_BURN = """
    w AS (SELECT dggid, 0 AS d FROM grid WHERE k % 211 = 0 UNION SELECT t.neighbor_dggid, d + 1 FROM w
    JOIN topo t ON t.dggid = w.dggid{mask} WHERE d < {n}), m AS (SELECT dggid, MIN(d) d FROM w GROUP BY 1)
"""
_fire = lambda f: f.grid().select("dggid", F.when(F.col("k") % 211 == 0, "burning").otherwise("unburned").alias("state"))
add(
    "ca_history",
    f"""
        WITH {_BURN.format(n=4, mask='')} SELECT CAST(j AS INT) AS step, grid.dggid, CASE WHEN d IS NULL
        OR d > j THEN 'unburned' WHEN d = j THEN 'burning' ELSE 'burned' END AS state FROM grid LEFT
        JOIN m ON m.dggid = grid.dggid, (VALUES (0), (2), (4)) o(j)
    """,
    lambda f: automata.history(_fire(f), f.topo(), 4, every=2),
)
_COUNTS = """
    c AS (SELECT t.dggid, COUNT(CASE WHEN g.k % 3 = 0 THEN 1 END) AS n, COUNT(CASE WHEN g.k % 3 = 1 THEN 1 END) AS o
    FROM topo t JOIN grid g ON g.dggid = t.neighbor_dggid GROUP BY 1)
"""
_states = lambda f, *s: f.grid().select("dggid", F.element_at(F.array(*map(F.lit, s)), (F.col("k") % 3 + 1).cast("int")).alias("state"))
add(
    "ca_game_of_life",
    f"""
        WITH {_COUNTS} SELECT grid.dggid, CASE WHEN k % 3 = 0 AND n IN (2, 3) THEN 'alive' WHEN k % 3 <> 0
        AND n = 3 THEN 'alive' ELSE 'dead' END AS state FROM grid LEFT JOIN c ON c.dggid = grid.dggid
    """,
    lambda f: automata.run(_states(f, "alive", "dead", "dead"), f.topo(), 1, "game_of_life"),
)
add(
    "ca_epidemic",
    f"""
        WITH {_COUNTS} SELECT grid.dggid, CASE k % 3 WHEN 0 THEN 'recovered' WHEN 1 THEN CASE
        WHEN n >= 2 THEN 'infected' ELSE 'susceptible' END ELSE 'recovered' END AS state FROM grid LEFT
        JOIN c ON c.dggid = grid.dggid
    """,
    lambda f: automata.run(_states(f, "infected", "susceptible", "recovered"), f.topo(), 1, "epidemic"),
)
add(
    "ca_opinion",
    f"""
        WITH {_COUNTS} SELECT grid.dggid, CASE WHEN n > o THEN 'yes' WHEN o > n THEN 'no'
        ELSE ['yes', 'no', 'unsure'][k % 3 + 1] END AS state FROM grid LEFT JOIN c ON c.dggid = grid.dggid
    """,
    lambda f: automata.run(_states(f, "yes", "no", "unsure"), f.topo(), 1, "opinion"),
)
add(
    "ca_initialise",
    "SELECT dggid, CASE WHEN zone_id = 'Brand#11' THEN 'burning' ELSE 'unburned' END AS state FROM zone",
    lambda f: automata.initialise(
        _brands(f).withColumns(
            {"attr_key": F.lit("state"), "value_text": F.when(F.col("value_text") == "Brand#11", "burning")},
        ),
    )[0],
)

# -- models
_FUEL = "JOIN fuel ON fuel.dggid = t.neighbor_dggid"
add(
    "fire_spread",
    """
        WITH fuel AS (SELECT dggid FROM q97 WHERE value_num > 50), w AS (SELECT dggid, 0 AS d FROM fuel
        WHERE dggid IN (SELECT dggid FROM grid WHERE k % 211 = 0) UNION SELECT t.neighbor_dggid, d + 1 FROM w
        JOIN topo t ON t.dggid = w.dggid JOIN fuel ON fuel.dggid = t.neighbor_dggid
        WHERE d < 5), m AS (SELECT dggid, MIN(d) d FROM w GROUP BY 1) SELECT fuel.dggid, CASE
        WHEN d IS NULL THEN 'unburned' WHEN d = 5 THEN 'burning' ELSE 'burned' END AS state FROM fuel LEFT
        JOIN m ON m.dggid = fuel.dggid
    """,
    lambda f: ml.fire_spread(f.year(1997), f.every(211), f.topo(), 5, 50.0),
)
for _name, _t, _h, _w in (("normal", 25, 50, 10), ("dry", 35, 20, 15), ("extreme", 40, 10, 30)):
    _score = f"least(1.0::DOUBLE, ({_t} / 40::DOUBLE + (100 - {_h}) / 100::DOUBLE + {_w} / 30::DOUBLE) / 3 * (value_num / 50))"
    add(
        f"fire_risk_{_name}",
        f"""
            SELECT dggid, ROUND({_score}, 6) AS score, CASE WHEN {_score} >= 0.75 THEN 'extreme'
            WHEN {_score} >= 0.5 THEN 'high' WHEN {_score} >= 0.25 THEN 'moderate' ELSE 'low' END AS risk FROM q97
        """,
        lambda f, name=_name: rounded(ml.fire_risk(f.year(1997).withColumn("value_num", F.col("value_num") / 50), name), "score"),
    )


def _wide(f: Fixtures) -> DataFrame:
    return query.pivot_attributes(_cube(f), ["quantity", "price"])


add(
    "ml_linear_regression",
    f"""
        WITH x AS (SELECT q.dggid, q.tid, q.value_num AS quantity, p.value_num AS price FROM qty q
        JOIN price p ON p.dggid = q.dggid
        AND p.tid = q.tid), l AS (SELECT regr_slope(price, quantity) a, regr_intercept(price, quantity) b FROM x
        WHERE tid < 1998) SELECT dggid, tid, 'prediction' AS attr_key, ROUND(a * quantity + b, 3) AS value_num
        FROM x, l
    """,
    lambda f: rounded(
        ml.predict(ml.train(_wide(f), ["quantity"], "price", split_tid=1998)[0], _wide(f), ["quantity"]),
        "value_num",
        digits=3,
    ),
)

# -- sources and sinks
_RAW = """
    CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN props WHEN 2 THEN event_type WHEN 3 THEN '  '
    ELSE '{bad' END
"""
_raw = lambda: F.expr(_RAW.replace("VARCHAR", "STRING"))
add(
    "typed_values",
    f"""
        SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS DOUBLE) END AS value_num, CASE
        WHEN event_id % 5 = 1 THEN props END AS value_json, CASE
        WHEN event_id % 5 IN (2, 4) THEN {_RAW} END AS value_text FROM events
    """,
    lambda f: f.table("events").select("event_id", *[c.alias(k) for k, c in typed_value(_raw()).items()]),
)
add(
    "cells_insert_ignore",
    """
        SELECT dggid, value_num FROM q97 UNION ALL SELECT dggid, value_num FROM q98 WHERE dggid NOT IN (SELECT dggid
        FROM q97)
    """,
    lambda f: tables.insert_ignore(
        *[f.qty().where(f"tid = {y}").withColumn("tid", F.lit(0).cast("bigint")).select(*CELL) for y in (1997, 1998)]
    ).select("dggid", "value_num"),
)


def _stored(f: Fixtures) -> DataFrame:
    path = f"{work_dir(f.spark)}/store-{uuid.uuid4().hex}"
    tables.write_dataset(f.qty(), path, "quantities")
    tables.write_dataset(f.price(), path, "prices")
    return tables.read_dataset(f.spark, path, "prices").select(*CELL)


def _through_csv(f: Fixtures) -> DataFrame:
    path = f"{work_dir(f.spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(f.qty(), path)
    return tables.read_csv(f.spark, path).select(*CELL)


def _through_json(f: Fixtures) -> DataFrame:
    path = f"{work_dir(f.spark)}/json-{uuid.uuid4().hex}"
    f.qty().select("dggid", F.col("tid").alias("time"), F.col("attr_key").alias("key"), F.col("value_num").alias("value")).write.json(path)
    return tables.read_json_lines(f.spark, path).select(*CELL)


add("cells_through_json", "SELECT dggid, tid, attr_key, value_num FROM qty", _through_json)
add("store_one_dataset", "SELECT dggid, tid, attr_key, value_num FROM price", _stored)
add("cells_through_csv", "SELECT dggid, tid, attr_key, value_num FROM qty", _through_csv)
_POINTS = """
    xy AS (SELECT dggid, 30.0::DOUBLE * pow(3.0::DOUBLE, -1.5::DOUBLE) * sqrt(3.0::DOUBLE) * (q + r / 2.0::DOUBLE) x,
    30.0::DOUBLE * pow(3.0::DOUBLE, -1.5::DOUBLE) * 1.5::DOUBLE * r y
    FROM grid), ll AS (SELECT dggid, x * cos(pi() / 2) - y * sin(pi() / 2) lon, degrees(asin(greatest(-1.0::DOUBLE,
    least(1.0::DOUBLE, radians(x * sin(pi() / 2) + y * cos(pi() / 2)))))) lat FROM xy)
"""


def _parsed(features: DataFrame) -> DataFrame:
    """Features read back from their JSON."""
    at = lambda p: F.get_json_object("feature", f"$.{p}")
    number = lambda p: at(p).cast("double")
    point = [(F.round(number(f"geometry.coordinates[{k}]"), 5) + 0.0).alias(n) for k, n in enumerate(("lon", "lat"))]
    kind, tid = at("geometry.type").alias("kind"), at("properties.tid").cast("bigint").alias("tid")
    return features.select("dggid", kind, tid, number("properties.value_num").alias("value_num"), *point)


_FEATURES = "ROUND(lon, 5) + 0.0::DOUBLE AS lon, ROUND(lat, 5) + 0.0::DOUBLE AS lat"
add(
    "geojson_features",
    f"WITH {_POINTS} SELECT dggid, 'Point' AS kind, tid, value_num, {_FEATURES} FROM qty JOIN ll USING (dggid)",
    lambda f: _parsed(sinks.features(f.qty(), LATTICE.centroid(F.col("dggid")))),
)
add(
    "items_page",
    f"""
        WITH {_POINTS} SELECT dggid, 'Point' AS kind, tid, value_num, {_FEATURES} FROM qty JOIN ll USING (dggid)
        WHERE lon BETWEEN -50 AND 0 AND lat BETWEEN 0 AND 60 ORDER BY dggid, tid, attr_key LIMIT 40 OFFSET 15
    """,
    lambda f: _parsed(sinks.items_page(f.qty(), LATTICE.centroid(F.col("dggid")), (-50, 0, 0, 60), limit=40, offset=15)),
)


def _polygons(f: Fixtures) -> DataFrame:
    return sinks.polygons(f.grid(), LATTICE.vertices(F.col("dggid")), LATTICE.level(F.col("dggid")))


def _cached(f: Fixtures) -> DataFrame:
    """Five polygons, then all of them, put into the cache; those of the mask got from it."""
    cache = sinks.cache_put(_polygons(f).limit(5), _polygons(f))
    found = sinks.cache_get(cache, f.mask().select(F.col("dggid").alias("zone_id")))
    return found.select("zone_id", "refinement", F.size("ring").alias("corners"))


add("polygon_cache", "SELECT dggid AS zone_id, 3 AS refinement, 7 AS corners FROM mask", _cached)
add(
    "polygon_cache_query",
    "SELECT 3 AS refinement, COUNT(*) AS polygons FROM grid",
    lambda f: sinks.cache_query(
        _polygons(f),
        "SELECT refinement, COUNT(*) AS polygons FROM {cache} GROUP BY refinement",
    ),
)


def _pixels(f: Fixtures) -> DataFrame:
    """The parts' prices as a raster of their lattice."""
    x = f.elev().join(f.grid(), "dggid")
    return x.select(F.col("r").alias("row"), F.col("q").alias("col"), F.col("value_num").alias("value"))


_places = lambda f: f.grid().select("dggid", (F.col("q") - 1 + 0.5).alias("lon"), (10 - F.col("r") - 0.5).alias("lat"))
add(
    "raster_sample",
    """
        SELECT g.dggid, CAST(7 AS BIGINT) AS tid, 'price' AS attr_key, e.value_num FROM grid g
        JOIN grid p ON p.q = g.q - 1 AND p.r = g.r JOIN elev e ON e.dggid = p.dggid WHERE e.value_num >= 905
    """,
    lambda f: rasters.sample(_pixels(f), rasters.Raster(0.0, 10.0, 1.0, 1.0, 100_000, 50), _places(f), "price", 7, least=905),
)
add(
    "raster_sample_clamped",
    """
        SELECT g.dggid, CAST(0 AS BIGINT) AS tid, 'price' AS attr_key, e.value_num FROM grid g
        JOIN grid p ON p.q = greatest(0, least(29, g.q - 1)) AND p.r = least(3, g.r) JOIN elev e ON e.dggid = p.dggid
    """,
    lambda f: rasters.sample(_pixels(f), rasters.Raster(0.0, 10.0, 1.0, 1.0, 4, 30), _places(f), "price", clamp=True),
)
add(
    "manifest_to_load",
    """
        SELECT n_name AS name, n_nationkey % 3 + 1 AS min_lvl, 7 AS max_lvl FROM nation WHERE NOT (n_nationkey % 2 = 0
        AND n_nationkey % 3 = 1)
    """,
    lambda f: rasters.to_ingest(
        f.table("nation").select(
            F.col("n_name").alias("name"),
            (F.col("n_nationkey") % 3 + 1).alias("min_lvl"),
            F.lit(7).alias("max_lvl"),
        ),
        f.table("nation").where("n_nationkey % 2 = 0").select(
            F.col("n_name").alias("name"),
            F.lit("active").alias("status"),
            F.lit('{"min_lvl": 2, "max_lvl": 7}').alias("metadata"),
        ),
    ),
)

# -- the catalogue and access
_SEE = ("id", "name")
add(
    "datasets_search",
    "SELECT id, name FROM ds WHERE lower(name) LIKE '%result 100!%%' ESCAPE '!' AND status = 'active'",
    lambda f: query.search_datasets(f.datasets(), "RESULT 100%", "active").select(*_SEE),
)
add(
    "datasets_active_page",
    """
        SELECT id, (SELECT COUNT(*) FROM ds WHERE status = 'active') AS number_matched FROM ds WHERE status = 'active'
        ORDER BY created_at DESC, id LIMIT 10 OFFSET 5
    """,
    lambda f: catalog.active_page(f.datasets(), 10, 5).select("id", "number_matched"),
)
_OF_OP = "(metadata->>'$.source' IN ('spatial_op', 'operation') OR metadata->>'$.source_type' IN ('spatial_op', 'operation'))"
_SHOWN = """
    (COALESCE(lower(metadata->>'$.source') IN ('spatial_op', 'operation'), FALSE)
    OR COALESCE(lower(metadata->>'$.source_type') IN ('spatial_op', 'operation'), FALSE)
    OR (metadata->>'$.type' IS NOT NULL AND json_type(metadata, '$.parents') IS NOT DISTINCT FROM 'ARRAY')
    OR lower(name) LIKE '% result%' OR lower(name) LIKE '%result')
"""
add(
    "datasets_results",
    f"SELECT id, name FROM ds WHERE {_SHOWN}",
    lambda f: catalog.split_results(f.datasets())[1].select(*_SEE),
)
add(
    "datasets_data",
    f"SELECT id, name FROM ds WHERE NOT {_SHOWN}",
    lambda f: catalog.split_results(f.datasets())[0].select(*_SEE),
)
add(
    "datasets_leftover",
    f"""
        SELECT id, name FROM ds WHERE COALESCE({_OF_OP}, FALSE) OR (metadata->'$.parents') IS NOT NULL
        OR name ILIKE '% result%'
    """,
    lambda f: f.datasets().where(catalog.is_leftover()).select(*_SEE),
)
_now = lambda: F.lit("2024-01-05 00:00:00").cast("timestamp")
add(
    "datasets_expired",
    f"SELECT id, name FROM ds WHERE {_OF_OP} AND created_at < TIMESTAMP '2024-01-03'",
    lambda f: catalog.expired(f.datasets(), 48, _now()).select(*_SEE),
)
add(
    "cells_without_expired",
    f"""
        WITH gone AS (SELECT id FROM ds WHERE {_OF_OP} AND created_at < TIMESTAMP '2024-01-03')
        SELECT CAST(k % 40 AS VARCHAR) AS dataset_id, dggid FROM grid WHERE CAST(k % 40 AS VARCHAR) NOT IN (SELECT id
        FROM gone)
    """,
    lambda f: catalog.without_expired(
        f.datasets(),
        f.grid().select((F.col("k") % 40).cast("string").alias("dataset_id"), "dggid"),
        48,
        _now(),
    )[1].select("dataset_id", "dggid"),
)
add(
    "metadata_merged",
    """
        SELECT id, CASE WHEN id = '8' THEN '7'
        ELSE metadata->>'$.rows' END AS rows, metadata->>'$.source' AS source, CASE
        WHEN id = '8' THEN '[1,2.5]' END AS levels, replace(CAST(metadata->'$.bands' AS VARCHAR), ' ', '') AS bands
        FROM ds
    """,
    lambda f: catalog.merge_metadata(f.datasets(), "8", {"rows": 7, "levels": [1, 2.5], "gone": None}).select(
        "id",
        *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("rows", "source", "levels", "bands")],
    ),
)
add(
    "uploads_page",
    """
        SELECT id, status FROM up WHERE created_by = 'u3' AND status = 'active'
        ORDER BY created_at DESC, id LIMIT 15 OFFSET 3
    """,
    lambda f: catalog.uploads_of(f.uploads(), "u3", "active", 15, 3).select("id", "status"),
)
add(
    "upload_status",
    "SELECT id, status, filename FROM up WHERE id = '3'",
    lambda f: tables.get_row(f.uploads(), {"id": "3"}).select("id", "status", "filename"),
)
add(
    "datasets_acl",
    """
        SELECT id, name FROM ds WHERE visibility = 'public' OR created_by = 'u3' OR (visibility = 'shared'
        AND shared_user = 'u3')
    """,
    lambda f: f.datasets().where(access.visible_datasets("u3", "viewer")).select(*_SEE),
)
add(
    "datasets_may_change",
    "SELECT id, name FROM ds WHERE created_by = 'u3'",
    lambda f: f.datasets().where(access.may_change("u3", "editor")).select(*_SEE),
)

# -- scenes
add(
    "scenes_search",
    """
        SELECT id FROM items WHERE collection = 'sentinel' AND w <= 20 AND w + 10 >= -15 AND s <= 30 AND s + 10 >= 0
        AND acquired >= TIMESTAMP '1995-01-01' AND acquired <= TIMESTAMP '1997-06-30' AND cloud_cover < 60
    """,
    lambda f: stac.search(
        f.items(),
        "sentinel",
        (-15, 0, 20, 30),
        "1995-01-01T00:00:00Z",
        "1997-06-30T00:00:00Z",
        60,
    ).select("id"),
)
_scenes = lambda f: stac.normalise(f.items())
add(
    "scenes_bands",
    """
        SELECT id, 'B04' AS band, 'red/' || id[2:] AS href FROM items UNION ALL SELECT id, 'B02', 'blue/' || id[2:]
        FROM items WHERE has_blue
    """,
    lambda f: _scenes(f).select("id", F.explode("bands").alias("band", "file")).select("id", "band", "file.href"),
)
add(
    "scenes_named_bands",
    """
        SELECT id, 'blue' AS band, CASE WHEN has_thumb THEN 'thumb/' || id[2:] END AS thumbnail FROM items
        WHERE has_blue
    """,
    lambda f: stac.normalise(f.items(), {"B02": "blue"}).select(
        "id",
        F.explode("bands").alias("band", "file"),
        "thumbnail",
    ).select("id", "band", "thumbnail"),
)
add(
    "scenes_missing_bands",
    "SELECT id, 'B02' AS missing FROM items WHERE NOT has_blue",
    lambda f: stac.missing_bands(_scenes(f), ["B02", "B04"]).select("id", F.explode("missing").alias("missing")),
)
add(
    "scenes_all_bands",
    "SELECT collection, 'B02,B04' AS bands FROM items GROUP BY 1",
    lambda f: stac.all_bands(_scenes(f)).select("collection", F.array_join("bands", ",").alias("bands")),
)
add(
    "scenes_newest",
    "SELECT id FROM items WHERE collection = 'landsat' ORDER BY acquired DESC NULLS LAST, id LIMIT 30",
    lambda f: stac.newest(_scenes(f).where("collection = 'landsat'")).select("id").limit(30),
)
add(
    "scenes_chosen",
    "SELECT id, collection FROM items WHERE id IN ('s1', 's3', 's7')",
    lambda f: stac.chosen(_scenes(f), ["s1", "s3", "s7"]).select("id", "collection"),
)
add(
    "collections_detail",
    """
        SELECT collection, COUNT(*) AS scenes, CAST(COUNT(*) * 2 AS BIGINT) AS covered,
        CAST(MIN(acquired) AS VARCHAR) AS first, CAST(MAX(acquired) AS VARCHAR) AS last FROM items GROUP BY 1
    """,
    lambda f: stac.collections(_scenes(f), _scenes(f).select("id", F.array(F.lit("a"), F.lit("b")).alias("zones"))).select(
        "collection",
        "scenes",
        "covered",
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "last")],
    ),
)
add(
    "build_collection",
    """
        SELECT 'mine' AS name, 'sentinel' AS collection, LEAST(50, COUNT(*)) AS scene_count, 'ready' AS status
        FROM items WHERE collection = 'sentinel' AND cloud_cover < 30
    """,
    lambda f: stac.build_collection(f.items(), "mine", "sentinel", LATTICE, max_cloud=30, level=2)[0].drop("error"),
)


# -- streams
def _streamed(f: Fixtures) -> DataFrame:
    """All events as a stream of one file, merged batch by batch."""
    schema = f.table("events").schema
    events = f.spark.readStream.schema(schema).parquet(f"{f.dir}/events.parquet*")
    readings = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 50).cast("string").alias("dggid"),
        F.col("event_type").alias("attr_key"),
        F.col("value").alias("value_num"),
    )
    path = f"{work_dir(f.spark)}/stream-{uuid.uuid4().hex}"
    streams.merge_batches(streams.hourly_cells(readings), f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return streams.merged(f.spark, f"{path}/out").select(*CELL, "readings")


add(
    "stream_hourly_merged",
    """
        SELECT CAST(user_id % 50 AS VARCHAR) AS dggid, CAST(epoch(date_trunc('hour',
        CAST(ts AS TIMESTAMP))) // 3600 AS BIGINT) AS tid, event_type AS attr_key, ROUND(AVG(value), 6) AS value_num,
        COUNT(*) AS readings FROM events GROUP BY 1, 2, 3
    """,
    lambda f: rounded(_streamed(f), "value_num"),
)

# -- no SQL: the hull's corners
add(
    "zone_hull",
    None,
    lambda f: geometry.convex_hull(
        f.zone().withColumn("c", LATTICE.centroid(F.col("dggid"))).select("zone_id", "dggid", "c.lon", "c.lat"),
        "zone_id",
    ),
)
