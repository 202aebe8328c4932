"""Queries of the operators on cells, each with the SQL that it must match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import access, catalog
from ..grid import HexLattice
from ..operators import automata, cluster, flow, geometry, neighborhood, overlay, query, reach, rollup, temporal, zonal
from ..sources import tables
from .registry import add, rounded

LATTICE = HexLattice()


def _at0(cells: DataFrame, tid: int) -> DataFrame:
    return cells.where(F.col("tid") == tid).withColumn("tid", F.lit(0).cast("bigint"))


CELL = ("dggid", "tid", "attr_key", "value_num")

# -- attribute queries
add(
    "cells_scan_range",
    "SELECT dggid, tid, attr_key, value_num FROM qty WHERE value_num BETWEEN 50 AND 200",
    lambda f: query.range_query(f.qty(), "quantity", 50, 200).select(*CELL),
)
add(
    "cells_filter_eq_num",
    "SELECT dggid, tid, attr_key, value_num FROM qty WHERE value_num = 100",
    lambda f: query.filter_query(f.qty(), "quantity", "100").select(*CELL),
)
add(
    "cells_filter_eq_text",
    "SELECT dggid, zone_id FROM zone WHERE zone_id = 'Brand#11'",
    lambda f: query.filter_query(
        f.zone().select(
            "dggid",
            F.lit("brand").alias("attr_key"),
            F.col("zone_id").alias("value_text"),
            F.lit(None).cast("double").alias("value_num"),
        ),
        "brand",
        "Brand#11",
    ).select("dggid", F.col("value_text").alias("zone_id")),
)
add(
    "cells_prefix_page",
    """
        SELECT dggid, tid, attr_key, value_num FROM qty WHERE starts_with(dggid, 'C3-1') AND tid = 1997
        ORDER BY dggid, tid LIMIT 100 OFFSET 20
    """,
    lambda f: query.list_cells(f.qty(), "quantity", "C3-1", 1997, 100, 20).select(*CELL),
)
add(
    "cells_lookup_viewport",
    "SELECT dggid, tid, attr_key, value_num FROM qty WHERE dggid IN (SELECT dggid FROM mask) AND tid = 1997",
    lambda f: query.lookup(f.qty(), f.mask(), "quantity", 1997).select(*CELL),
)
for _how, _f in (("avg", "AVG"), ("sum", "SUM"), ("min", "MIN"), ("max", "MAX"), ("count", "COUNT")):
    add(
        f"cells_aggregate_{_how}",
        f"SELECT dggid, ROUND(CAST({_f}(value_num) AS DOUBLE), 6) AS value FROM qty GROUP BY dggid",
        lambda f,
        how=_how: rounded(
            query.aggregate(f.qty(), "quantity", how).withColumn("value", F.col("value").cast("double")),
            "value",
        ),
    )
add(
    "attributes_pivot",
    """
        SELECT q.dggid, q.tid, q.value_num AS quantity, p.value_num AS price
        FROM qty q JOIN price p ON p.dggid = q.dggid AND p.tid = q.tid
    """,
    lambda f: query.pivot_attributes(f.qty().unionByName(f.price()), ["quantity", "price"]),
)
add(
    "map_algebra_local",
    """
        SELECT q.dggid, q.tid, p.value_num / q.value_num AS value_num
        FROM qty q JOIN price p ON p.dggid = q.dggid AND p.tid = q.tid
    """,
    lambda f: query.map_algebra(f.qty().unionByName(f.price()), ["quantity", "price"], "price / quantity"),
)
add(
    "zone_attribute_map",
    """
        SELECT dggid, attr_key, MAX(tid) AS tid, arg_max(value_num, tid) AS value_num FROM (SELECT * FROM qty
        UNION ALL SELECT * FROM price) GROUP BY 1, 2
    """,
    lambda f: query.zone_attributes(f.qty().unionByName(f.price())).select(
        "dggid",
        F.explode("attributes").alias("attr_key", "v"),
    ).select("dggid", "attr_key", "v.tid", "v.value_num"),
)
add(
    "level_histogram",
    "SELECT 3 AS level, COUNT(*) AS cells FROM grid UNION ALL SELECT 2, COUNT(DISTINCT parent_dggid) FROM parent",
    lambda f: query.level_histogram(
        f.grid().select("dggid").union(f.parent().select("parent_dggid")),
        LATTICE.level(F.col("dggid")),
    ),
)

# -- overlays and sets: two datasets that share some cells, times and attributes
_AB = """
    a AS (SELECT * FROM qty WHERE tid <= 1997 UNION ALL SELECT * FROM price WHERE tid = 1996), b AS (SELECT * FROM qty
    WHERE tid >= 1997 UNION ALL SELECT dggid, tid, 'quantity', value_text, value_num FROM price WHERE tid = 1996)
"""
_a = lambda f: f.qty().where("tid <= 1997").unionByName(f.price().where("tid = 1996"))
_b = lambda f: f.qty().where("tid >= 1997").unionByName(f.price().where("tid = 1996").withColumn("attr_key", F.lit("quantity")))
_ONLY = """
    SELECT {x}.dggid, {x}.tid, {x}.attr_key, {x}.value_num FROM {x} WHERE NOT EXISTS (SELECT 1 FROM {y}
    WHERE {y}.dggid = {x}.dggid AND {y}.tid = {x}.tid AND {y}.attr_key = {x}.attr_key)
"""
add(
    "overlay_intersection",
    f"""
        WITH {_AB} SELECT dggid, tid, attr_key, (a.value_num + b.value_num) / 2 AS value_num
        FROM a JOIN b USING (dggid, tid, attr_key)
    """,
    lambda f: overlay.intersection(_a(f), _b(f)).select(*CELL),
)
add(
    "overlay_union",
    f"WITH {_AB} SELECT dggid, tid, attr_key, value_num FROM a UNION ALL " + _ONLY.format(x="b", y="a"),
    lambda f: overlay.union(_a(f), _b(f)).select(*CELL),
)
add(
    "overlay_difference",
    f"WITH {_AB} " + _ONLY.format(x="a", y="b"),
    lambda f: overlay.difference(_a(f), _b(f)).select(*CELL),
)
add(
    "overlay_symdiff",
    f"WITH {_AB} " + _ONLY.format(x="a", y="b") + " UNION ALL " + _ONLY.format(x="b", y="a"),
    lambda f: overlay.symmetric_difference(_a(f), _b(f)).select(*CELL),
)
add(
    "overlay_clip",
    "SELECT dggid, tid, attr_key, value_num FROM qty WHERE dggid IN (SELECT dggid FROM mask)",
    lambda f: overlay.clip(f.qty(), f.mask()).select(*CELL),
)
add(
    "merge_layers",
    "SELECT dggid, tid, attr_key, value_num FROM qty UNION ALL SELECT dggid, tid, attr_key, value_num FROM elev",
    lambda f: overlay.merge_layers(f.qty().select(*CELL), f.elev().select(*CELL)),
)
_SETS = lambda f: (f.year(1996), f.year(1997), f.year(1998))
add(
    "setop_intersect3",
    " INTERSECT ".join("SELECT dggid FROM qty WHERE tid = " + y for y in ("1996", "1997", "1998")),
    lambda f: overlay.ids_intersection(*_SETS(f)),
)
add(
    "setop_union3",
    " UNION ".join("SELECT dggid FROM qty WHERE tid = " + y for y in ("1996", "1997", "1998")),
    lambda f: overlay.ids_union(*_SETS(f)),
)
add(
    "setop_except3",
    "SELECT dggid FROM grid EXCEPT SELECT dggid FROM q97 WHERE value_num > 60 EXCEPT SELECT dggid FROM mask",
    lambda f: overlay.ids_difference(f.grid(), f.year(1997).where("value_num > 60"), f.mask()),
)

# -- hierarchy
for _how, _f in (("avg", "AVG"), ("sum", "SUM"), ("min", "MIN"), ("max", "MAX"), ("count", "COUNT"), ("stddev", "STDDEV")):
    add(
        f"rollup_parent_{_how}",
        f"""
            SELECT parent_dggid, ROUND(CAST({_f}(value_num) AS DOUBLE), 6) AS value_num, COUNT(*) AS child_count
            FROM q97 JOIN parent USING (dggid) GROUP BY 1
        """,
        lambda f,
        how=_how: rounded(
            rollup.rollup(f.year(1997), f.parent(), how).withColumn("value_num", F.col("value_num").cast("double")),
            "value_num",
        ),
    )
add(
    "rollup_literal_sum",
    """
        SELECT parent_dggid, ROUND(SUM(value_num), 6) AS value_num, COUNT(*) AS child_count
        FROM q97 JOIN topo USING (dggid) JOIN parent USING (dggid) GROUP BY 1
    """,
    lambda f: rounded(rollup.rollup(f.year(1997), f.topo().join(f.parent(), "dggid"), "sum", literal=True), "value_num"),
)
add(
    "rollup_mode",
    """
        SELECT parent_dggid, zone_id AS value_text, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_dggid
        ORDER BY n DESC, zone_id) k FROM (SELECT parent_dggid, zone_id, COUNT(*) n FROM zone JOIN parent USING (dggid)
        GROUP BY 1, 2)) WHERE k = 1
    """,
    lambda f: rollup.rollup_mode(f.zone().withColumnRenamed("zone_id", "value_text"), f.parent()),
)
_ID = """
    'C{l}-' || CASE WHEN {q}<0 THEN 'n' ELSE '' END || CAST(abs({q}) AS VARCHAR) || '-' || CASE WHEN {r}<0 THEN 'n'
    ELSE '' END || CAST(abs({r}) AS VARCHAR)
"""
_UP = "CASE ((q-r)%3+3)%3 WHEN 1 THEN q-1 WHEN 2 THEN q+1 ELSE q END"
add(
    "pyramid_level1",
    f"""
        WITH l2 AS (SELECT 2 AS level, ({_UP} - r)//3 AS q, ({_UP} + 2*r)//3 AS r, AVG(value_num) AS value_num
        FROM q97 JOIN (SELECT dggid AS d, q, r FROM grid) ON d = dggid
        GROUP BY 2, 3), l1 AS (SELECT 1 AS level, ({_UP} - r)//3 AS q, ({_UP} + 2*r)//3 AS r,
        AVG(value_num) AS value_num FROM l2 GROUP BY 2, 3)
        SELECT level, {_ID.format(l=2, q='q', r='r')} AS dggid, ROUND(value_num, 6) AS value_num FROM l2 UNION ALL
        SELECT level, {_ID.format(l=1, q='q', r='r')}, ROUND(value_num, 6) FROM l1
    """,
    lambda f: rounded(rollup.pyramid(f.year(1997), LATTICE.parent, 3, 1), "value_num"),
)
add(
    "expand_children",
    f"SELECT {_ID.format(l=4, q='(2*q+r+d)', r='(r-q)')} AS dggid FROM grid, (VALUES (0), (1), (-1)) o(d)",
    lambda f: rollup.expand(f.grid(), LATTICE.children, 1),
)
add(
    "ancestors_2",
    f"""
        WITH l2 AS (SELECT ({_UP} - r)//3 AS q, ({_UP} + 2*r)//3 AS r
        FROM grid), l1 AS (SELECT ({_UP} - r)//3 AS q, ({_UP} + 2*r)//3 AS r FROM l2)
        SELECT DISTINCT {_ID.format(l=1, q='q', r='r')} AS dggid FROM l1
    """,
    lambda f: rollup.ancestors(f.grid(), LATTICE.parent, 2),
)
add(
    "hex_distance",
    "SELECT dggid, CAST((abs(q-3) + abs(r-2) + abs(q-3+r-2)) // 2 AS BIGINT) AS distance FROM grid",
    lambda f: f.grid().select("dggid", LATTICE.distance(F.col("dggid"), F.lit("C3-3-2")).alias("distance")),
)
add(
    "boundary_cells",
    """
        SELECT m.dggid, COUNT(n.dggid) AS neighbors_inside FROM mask m LEFT JOIN topo t ON t.dggid = m.dggid
        LEFT JOIN mask n ON n.dggid = t.neighbor_dggid GROUP BY 1 HAVING COUNT(n.dggid) < 6
    """,
    lambda f: neighborhood.boundary_cells(f.mask(), f.topo()),
)

# -- zonal statistics
_STATS = """
    ROUND(SUM(value_num), 6) AS sum, ROUND(AVG(value_num), 6) AS mean, MIN(value_num) AS min, MAX(value_num) AS max,
    ROUND(MEDIAN(value_num), 6) AS median, ROUND(STDDEV(value_num), 6) AS stddev,
    ROUND(VARIANCE(value_num), 4) AS variance, COUNT(value_num) AS count
"""
_stats = lambda df: rounded(rounded(df, "sum", "mean", "median", "stddev"), "variance", digits=4)
add(
    "zonal_basic",
    f"""
        SELECT attr_key AS variable, {_STATS} FROM (SELECT attr_key, value_num FROM qty UNION ALL
        SELECT attr_key, value_num FROM elev) GROUP BY 1
    """,
    lambda f: _stats(
        zonal.zonal_statistics(
            f.qty().select("dggid", F.col("attr_key").alias("variable"), "value_num").unionByName(
                f.elev().select("dggid", F.col("attr_key").alias("variable"), "value_num"),
            ),
            ["variable"],
        ),
    ),
)
add(
    "zonal_masked",
    f"SELECT attr_key AS variable, {_STATS} FROM qty WHERE dggid IN (SELECT dggid FROM mask) GROUP BY 1",
    lambda f: _stats(zonal.zonal_statistics(f.qty().withColumnRenamed("attr_key", "variable"), ["variable"], mask=f.mask())),
)
add(
    "zonal_percentiles",
    (
        "SELECT tid, "
        + ", ".join(f"ROUND(quantile_cont(value_num, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90))
        + " FROM qty GROUP BY 1"
    ),
    lambda f: rounded(zonal.percentiles(f.qty(), ["tid"]), "p25", "p50", "p75", "p90"),
)
add(
    "zonal_mode",
    """
        SELECT tid, value_num, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tid ORDER BY n DESC, value_num) k
        FROM (SELECT tid, value_num, COUNT(*) n FROM qty GROUP BY 1, 2)) WHERE k = 1
    """,
    lambda f: zonal.mode(f.qty(), ["tid"]),
)
add(
    "zonal_histogram",
    """
        WITH e AS (SELECT tid, MIN(value_num) lo, MAX(value_num) hi FROM qty
        GROUP BY 1), w AS (SELECT tid, CASE WHEN hi <= lo THEN 0.0::DOUBLE ELSE lo END lo,
        (CASE WHEN hi <= lo THEN 1.0::DOUBLE ELSE hi END - CASE WHEN hi <= lo THEN 0.0::DOUBLE ELSE lo END) / 10 w
        FROM e) SELECT tid, CAST(FLOOR((value_num - lo) / w) AS BIGINT) AS bin,
        ROUND(MIN(lo + FLOOR((value_num - lo) / w) * w), 6) AS bin_start,
        ROUND(MIN(lo + (FLOOR((value_num - lo) / w) + 1) * w), 6) AS bin_end, COUNT(*) AS count
        FROM qty JOIN w USING (tid) GROUP BY 1, 2
    """,
    lambda f: rounded(zonal.histogram(f.qty(), ["tid"]), "bin_start", "bin_end"),
)
add(
    "zonal_by_zone",
    """
        SELECT zone_id, ROUND(AVG(value_num), 6) AS result, COUNT(value_num) AS count,
        COUNT(DISTINCT zone.dggid) AS zone_cells FROM zone LEFT JOIN qty ON qty.dggid = zone.dggid GROUP BY 1
    """,
    lambda f: rounded(zonal.zonal_by_zone(f.qty(), f.zone()), "result"),
)
_CORR = "WITH x AS (SELECT q.value_num a, p.value_num b FROM qty q JOIN price p ON p.dggid = q.dggid AND p.tid = q.tid)"
add(
    "corr_pearson",
    f"""
        {_CORR}
        SELECT 'quantity' AS var_a, 'price' AS var_b, ROUND(corr(a, b), 6) AS correlation, COUNT(*) AS cell_count
        FROM x
    """,
    lambda f: rounded(zonal.correlations(f.qty().unionByName(f.price()), ["quantity", "price"]), "correlation"),
)
add(
    "corr_spearman",
    f"""
        {_CORR}, y AS (SELECT RANK() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE ra,
        RANK() OVER (ORDER BY b) + (COUNT(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE rb FROM x)
        SELECT 'quantity' AS var_a, 'price' AS var_b, ROUND(corr(ra, rb), 6) AS correlation, COUNT(*) AS cell_count
        FROM y
    """,
    lambda f: rounded(zonal.correlations(f.qty().unionByName(f.price()), ["quantity", "price"], "spearman"), "correlation"),
)

# -- neighbourhoods
_SIG = """
    CASE WHEN abs({z}) >= 2.58 THEN 'p<0.01' WHEN abs({z}) >= 1.96 THEN 'p<0.05' WHEN abs({z}) >= 1.65 THEN 'p<0.10'
    ELSE 'not significant' END
"""
add(
    "morans_i",
    (
        """
              WITH c AS (SELECT COUNT(*) w, SUM((v - m) * (v_n - m)) c
              FROM nb, st), s AS (SELECT COUNT(*) n, SUM((value_num - m) * (value_num - m)) ss
              FROM q97, st), i AS (SELECT s.n, w, s.n * c.c / w / ss i, -1.0::DOUBLE / (s.n - 1) e FROM c, s)
              SELECT n, w, ROUND(i, 6) AS morans_i, ROUND(e, 6) AS expected_i, ROUND((i - e) * sqrt(n), 4) AS z,
          """
        + _SIG.format(z="((i - e) * sqrt(n))")
        + """
              AS significance,
              CASE WHEN i > e + 0.1 THEN 'clustered' WHEN i < e - 0.1 THEN 'dispersed' ELSE 'random' END AS interpretation
              FROM i
          """
    ),
    lambda f: neighborhood.morans_i(f.year(1997), f.topo()),
)
add(
    "gearys_c",
    """
        WITH c AS (SELECT COUNT(*) w, SUM((v - v_n) * (v - v_n)) c
        FROM nb), s AS (SELECT COUNT(*) n, SUM((value_num - m) * (value_num - m)) ss FROM q97, st)
        SELECT s.n, w, ROUND((s.n - 1) * c.c / (2 * w * ss), 6) AS gearys_c FROM c, s
    """,
    lambda f: neighborhood.gearys_c(f.year(1997), f.topo()),
)
_LISA = """
    x AS (SELECT dggid, v, (v - m) / sd z, SUM((v_n - m) / sd) / COUNT(*) lag, COUNT(*) k FROM nb, st
    GROUP BY dggid, v, m, sd)
"""
add(
    "lisa",
    f"""
        WITH {_LISA} SELECT dggid, v AS value, ROUND(z, 4) AS z, ROUND(z * lag, 4) AS local_i, ROUND(lag, 4) AS lag,
        k AS neighbor_count, CASE WHEN abs(z * lag) <= 1.96 THEN 'NS' WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z < 0
        AND lag < 0 THEN 'LL' WHEN z > 0 AND lag < 0 THEN 'HL' WHEN z < 0 AND lag > 0 THEN 'LH'
        ELSE 'NS' END AS cluster_type, abs(z * lag) > 1.96 AS significant FROM x
    """,
    lambda f: neighborhood.lisa(f.year(1997), f.topo()),
)
add(
    "hotspot_gi",
    (
        """
              WITH x AS (SELECT dggid, v, SUM(v_n) s, COUNT(*) k FROM nb GROUP BY 1, 2), g AS (SELECT dggid, v, s, k,
              (s - m * k) / (sd * sqrt((n * k - k * k) / (n - 1)::DOUBLE)) gi FROM x, st)
              SELECT dggid, v AS value, s AS local_sum, k AS neighbor_count, ROUND(gi, 4) AS gi_z,
              CASE WHEN gi > 0 THEN 'hotspot' ELSE 'coldspot' END AS type,
          """
        + _SIG.format(z="gi")
        + " AS significance FROM g"
    ),
    lambda f: neighborhood.hotspots(f.year(1997), f.topo()),
)
add(
    "focal_mean",
    "SELECT dggid, ROUND(AVG(v_n), 6) AS focal_mean, COUNT(*) AS neighbor_count FROM nb GROUP BY 1",
    lambda f: rounded(neighborhood.focal_mean(f.year(1997), f.topo()), "focal_mean"),
)
add(
    "contour_levels",
    """
        WITH e AS (SELECT MIN(value_num) lo, MAX(value_num) hi
        FROM q97), t AS (SELECT CAST(j AS INT) AS level, lo + (hi - lo) * j / 10 t FROM e, range(1, 10) r(j))
        SELECT DISTINCT dggid, level, ROUND(t, 6) AS threshold, v AS value FROM nb JOIN t ON v >= t AND v_n < t
    """,
    lambda f: rounded(neighborhood.contour(f.year(1997), f.topo(), 10), "threshold"),
)
add(
    "change_detection",
    """
        SELECT * FROM (SELECT COALESCE(a.dggid, b.dggid) AS dggid, a.value_num AS before, b.value_num AS after,
        COALESCE(b.value_num, 0) - COALESCE(a.value_num, 0) AS abs_change,
        ROUND((b.value_num - a.value_num) / NULLIF(abs(a.value_num), 0) * 100, 6) AS pct_change, CASE
        WHEN a.dggid IS NULL THEN 'appeared' WHEN b.dggid IS NULL THEN 'disappeared'
        WHEN b.value_num = a.value_num THEN 'stable' WHEN b.value_num > a.value_num THEN 'gain'
        ELSE 'loss' END AS change_type FROM q97 a FULL JOIN q98 b ON a.dggid = b.dggid) WHERE change_type <> 'stable'
    """,
    lambda f: rounded(neighborhood.change(f.year(1997), f.year(1998)), "pct_change"),
)

# -- flow
_DIR = """
    dir AS (SELECT dggid, target, v - v_n AS "drop", v, v_n
    FROM (SELECT a.dggid, t.neighbor_dggid target, a.value_num v, b.value_num v_n,
    ROW_NUMBER() OVER (PARTITION BY a.dggid ORDER BY b.value_num, t.neighbor_dggid) k
    FROM elev a JOIN topo t ON t.dggid = a.dggid JOIN elev b ON b.dggid = t.neighbor_dggid
    WHERE b.value_num < a.value_num) WHERE k = 1)
"""
_direction = lambda f: flow.flow_direction(f.elev(), f.topo())
add(
    "flow_direction",
    f"WITH {_DIR} SELECT dggid, target, ROUND(\"drop\", 6) AS \"drop\", v AS source_elev, v_n AS target_elev FROM dir",
    lambda f: rounded(_direction(f), "drop"),
)
add(
    "flow_upstream",
    f"WITH {_DIR} SELECT target AS dggid, COUNT(*) AS upstream FROM dir GROUP BY 1",
    lambda f: flow.upstream_counts(_direction(f)),
)
add(
    "flow_accumulation",
    f"""
        WITH {_DIR}, walk AS (SELECT dggid AS src, dggid AS here FROM elev UNION ALL SELECT w.src, d.target
        FROM walk w JOIN dir d ON d.dggid = w.here) SELECT here AS dggid, COUNT(*) AS flow FROM walk GROUP BY 1
    """,
    lambda f: flow.flow_accumulation(f.elev(), _direction(f)),
)

# -- reach
_HOPS = """
    seed AS (SELECT dggid FROM grid WHERE k % 97 = 0), reach AS (SELECT dggid, 0 AS d FROM seed UNION
    SELECT t.neighbor_dggid, d + 1 FROM reach r JOIN topo t ON t.dggid = r.dggid WHERE d < {k}{more})
"""
add(
    "buffer_k3",
    "WITH " + _HOPS.format(k=3, more="") + " SELECT DISTINCT dggid FROM reach",
    lambda f: reach.buffer(f.every(97), f.topo(), 3),
)
add(
    "buffer_weighted_k3",
    (
        "WITH "
        + _HOPS.format(k=3, more="")
        + """
              SELECT dggid, 1.0::DOUBLE / (MIN(d) + 1) AS value_num,
              CASE WHEN MIN(d) = 0 THEN 'Source' ELSE 'Buffer' END AS value_text, CAST(MIN(d) AS BIGINT) AS distance
              FROM reach GROUP BY 1
          """
    ),
    lambda f: reach.buffer_weighted(f.every(97), f.topo(), 3),
)
add(
    "propagate_k4_masked",
    (
        "WITH "
        + _HOPS.format(k=4, more=" AND t.neighbor_dggid IN (SELECT dggid FROM mask)")
        + " SELECT DISTINCT dggid FROM reach"
    ),
    lambda f: reach.propagate(f.every(97), f.topo(), f.mask(), 4),
)
_SPARSE = """
    sp AS (SELECT q97.dggid, value_num FROM q97 JOIN grid ON grid.dggid = q97.dggid
    WHERE k % 5 = 0), w AS (SELECT dggid AS src, dggid, 0 AS d FROM sp UNION SELECT src, t.neighbor_dggid, d + 1
    FROM w JOIN topo t ON t.dggid = w.dggid WHERE d < 2), s AS (SELECT src, dggid, MIN(d) d FROM w GROUP BY 1, 2)
"""
_sparse = lambda f: f.year(1997).join(f.every(5), "dggid", "left_semi")
_IDW = """
    SELECT x.dggid, ROUND(SUM(value_num / (d * d)) / SUM(1.0::DOUBLE / (d * d)), 6) AS value_num,
    COUNT(DISTINCT src) AS sources FROM {t} x JOIN sp ON sp.dggid = src WHERE d >= 1 AND x.dggid NOT IN (SELECT dggid
    FROM sp) GROUP BY 1 HAVING COUNT(DISTINCT src) >= 2
"""
add(
    "idw_r2",
    f"WITH {_SPARSE} {_IDW.format(t='s')}",
    lambda f: rounded(reach.idw(_sparse(f), f.topo(), 2), "value_num"),
)
add(
    "idw_r2_literal",
    f"WITH {_SPARSE} {_IDW.format(t='w')}",
    lambda f: rounded(reach.idw(_sparse(f), f.topo(), 2, literal=True), "value_num"),
)
_KDE = """
    SELECT x.dggid, ROUND(SUM(value_num * ({w})) / NULLIF(SUM({w}), 0), 6) AS density, COUNT(*) AS contributions
    FROM s x JOIN sp ON sp.dggid = src GROUP BY 1
"""
add(
    "kde_gaussian_bw2",
    f"WITH {_SPARSE} " + _KDE.format(w="exp(-0.5::DOUBLE * (d / 2.0::DOUBLE) * (d / 2.0::DOUBLE))"),
    lambda f: rounded(reach.kernel_density(_sparse(f), f.topo(), 2), "density"),
)
add(
    "kde_linear_bw2",
    f"WITH {_SPARSE} " + _KDE.format(w="greatest(0.0::DOUBLE, 1 - d / 2.0::DOUBLE)"),
    lambda f: rounded(reach.kernel_density(_sparse(f), f.topo(), 2, "linear"), "density"),
)
add(
    "kde_uniform_literal",
    f"""
        WITH {_SPARSE} SELECT dggid, ROUND(AVG(value_num), 6) AS density, COUNT(*) AS contributions
        FROM (SELECT DISTINCT w.dggid, d, value_num FROM w JOIN sp ON sp.dggid = src) GROUP BY 1
    """,
    lambda f: rounded(reach.kernel_density(_sparse(f), f.topo(), 2, "uniform", literal=True), "density"),
)
add(
    "voronoi_k10",
    """
        WITH seed AS (SELECT dggid FROM grid WHERE k % 211 = 0), w AS (SELECT dggid AS seed, dggid, 0 AS d FROM seed
        UNION SELECT w.seed, t.neighbor_dggid, d + 1 FROM w JOIN topo t ON t.dggid = w.dggid WHERE d < 10)
        SELECT dggid, seed, CAST(d AS BIGINT) AS distance FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dggid
        ORDER BY d, seed) k FROM w) WHERE k = 1
    """,
    lambda f: reach.voronoi(f.every(211), f.topo(), 10),
)
add(
    "nearest_neighbor",
    """
        WITH seed AS (SELECT dggid FROM grid WHERE k % 211 = 0), w AS (SELECT dggid AS seed, dggid, 0 AS d FROM seed
        UNION SELECT w.seed, t.neighbor_dggid, d + 1 FROM w JOIN topo t ON t.dggid = w.dggid WHERE d < 10)
        SELECT x.dggid, seed AS nearest, CAST(d AS BIGINT) AS distance
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dggid ORDER BY d, seed) k FROM w) x JOIN mask USING (dggid)
        WHERE k = 1
    """,
    lambda f: reach.nearest(f.mask(), f.every(211), f.topo(), 10),
)
add(
    "viewshed_r6",
    """
        WITH w AS (SELECT 'C3-2-2' AS dggid, 0 AS d UNION SELECT t.neighbor_dggid, d + 1
        FROM w JOIN topo t ON t.dggid = w.dggid WHERE d < 6), m AS (SELECT dggid, MIN(d) d FROM w
        GROUP BY 1), o AS (SELECT value_num + 1.8::DOUBLE eye FROM elev WHERE dggid = 'C3-2-2')
        SELECT m.dggid, CAST(d AS BIGINT) AS depth, value_num AS elevation, (value_num - eye) / d > -0.1 AS visible
        FROM m JOIN elev USING (dggid), o WHERE d >= 1
    """,
    lambda f: reach.viewshed(f.elev(), f.topo(), "C3-2-2", 1.8, 6),
)
_PATH = """
    WITH w AS (SELECT 'C3-1-0' AS dggid, 0.0::DOUBLE AS c, 0 AS h, 'C3-1-0' AS path UNION
    SELECT t.neighbor_dggid, w.c + {cost}, h + 1, path || ',' || t.neighbor_dggid
    FROM w JOIN topo t ON t.dggid = w.dggid{join} WHERE h < 6)
    SELECT TRUE AS found, ROUND(c, 6) AS total_cost, CAST(h AS BIGINT) AS hops{path} FROM w WHERE dggid = 'C3-3-2'
    ORDER BY c, h LIMIT 1
"""
add(
    "shortest_path_uniform",
    _PATH.format(cost="1", join="", path=""),
    lambda f: rounded(
        reach.shortest_path(f.topo(), "C3-1-0", "C3-3-2", max_hops=6).select("found", "total_cost", "hops"),
        "total_cost",
    ),
)
add(
    "shortest_path_weighted",
    _PATH.format(
        cost="COALESCE(q97.value_num, 1)",
        join=" LEFT JOIN q97 ON q97.dggid = t.neighbor_dggid",
        path=", path",
    ),
    lambda f: rounded(
        reach.shortest_path(
            f.topo(),
            "C3-1-0",
            "C3-3-2",
            f.year(1997),
            6,
        ).withColumn("path", F.array_join("path", ",")),
        "total_cost",
    ),
)

# -- clusters
_SIM = """
    sim AS (SELECT dggid, neighbor FROM nb, st
    WHERE abs(v - v_n) <= CASE WHEN sd > 0 THEN sd * 0.5 ELSE 1.0 END), core AS (SELECT dggid FROM sim
    GROUP BY 1 HAVING COUNT(*) >= 3)
"""
add(
    "dbscan_core_counts",
    f"""
        WITH {_SIM} SELECT q97.dggid, COUNT(neighbor) AS similar, COUNT(neighbor) >= 3 AS core FROM q97
        LEFT JOIN sim ON sim.dggid = q97.dggid GROUP BY 1
    """,
    lambda f: cluster.core_counts(f.year(1997), f.topo()),
)
add(
    "dbscan_labels",
    f"""
        WITH {_SIM}, lab AS (SELECT dggid, dggid AS l FROM core UNION SELECT s.neighbor, l
        FROM lab JOIN sim s ON s.dggid = lab.dggid JOIN core c ON c.dggid = s.neighbor
        WHERE l < s.neighbor), cl AS (SELECT dggid, MIN(l) l FROM lab GROUP BY 1), rim AS (SELECT s.dggid, MIN(l) l
        FROM sim s JOIN cl ON cl.dggid = s.neighbor WHERE s.dggid NOT IN (SELECT dggid FROM core)
        GROUP BY 1 HAVING MIN(l) < s.dggid), al AS (SELECT * FROM cl UNION ALL SELECT *
        FROM rim), num AS (SELECT l, ROW_NUMBER() OVER (ORDER BY l) - 1 id FROM (SELECT DISTINCT l FROM al))
        SELECT q97.dggid, COALESCE(id, -1) AS cluster_id FROM q97 LEFT JOIN al ON al.dggid = q97.dggid
        LEFT JOIN num ON num.l = al.l
    """,
    lambda f: cluster.dbscan(f.year(1997), f.topo()),
)

# -- time
add(
    "temporal_range",
    "SELECT dggid, tid, attr_key, value_num FROM qty WHERE tid BETWEEN 1996 AND 1998",
    lambda f: temporal.time_range(f.qty(), 1996, 1998).select(*CELL),
)
add(
    "temporal_snapshot",
    """
        SELECT dggid, attr_key, MAX(tid) AS tid, arg_max(value_num, tid) AS value_num FROM qty WHERE tid <= 1998
        GROUP BY 1, 2
    """,
    lambda f: temporal.snapshot(f.qty(), 1998).select("dggid", "attr_key", "tid", "value_num"),
)
_OVER_TIME = {
    "mean": "AVG(value_num)",
    "sum": "SUM(value_num)",
    "min": "MIN(value_num)",
    "max": "MAX(value_num)",
    "count": "CAST(COUNT(value_num) AS DOUBLE)",
    "first": "arg_min(value_num, tid)",
    "last": "arg_max(value_num, tid)",
}
for _how, _f in _OVER_TIME.items():
    add(
        f"temporal_aggregate_{_how}",
        f"""
            SELECT dggid, CAST(1999 AS BIGINT) AS tid, attr_key, ROUND({_f}, 6) AS value_num FROM qty
            WHERE tid BETWEEN 1996 AND 1999 GROUP BY dggid, attr_key
        """,
        lambda f,
        how=_how: rounded(temporal.temporal_aggregate(f.qty(), 1996, 1999, how), "value_num"),
    )
add(
    "temporal_difference",
    """
        SELECT COALESCE(a.dggid, b.dggid) AS dggid, 'quantity' AS attr_key, b.value_num - a.value_num AS diff,
        CASE WHEN a.dggid IS NULL THEN 'after only' WHEN b.dggid IS NULL THEN 'before only' ELSE 'both' END AS sides
        FROM q97 a FULL JOIN q98 b ON a.dggid = b.dggid
    """,
    lambda f: temporal.temporal_difference(f.qty(), f.qty(), 1997, 1998),
)
add(
    "timeseries",
    """
        SELECT tid - 1995 AS tid, CASE
        WHEN tid >= 1995 THEN ['instantaneous', 'minutely', 'hourly', 'daily', 'weekly', 'monthly', 'yearly', 'decade'][tid - 1994]
        ELSE 'unknown' END AS granularity, value_num FROM qty WHERE dggid = 'C3-7-1'
    """,
    lambda f: temporal.timeseries(f.qty().withColumn("tid", F.col("tid") - 1995), "C3-7-1", "quantity").drop("value_text"),
)
add(
    "temporal_moving_avg",
    """
        SELECT dggid, tid, attr_key, ROUND(AVG(value_num) OVER (PARTITION BY dggid
        ORDER BY tid ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS moving_avg FROM qty
    """,
    lambda f: rounded(temporal.moving_average(f.qty()), "moving_avg"),
)
add(
    "temporal_trend",
    """
        SELECT dggid, attr_key, ROUND(regr_slope(value_num, tid), 6) + 0.0::DOUBLE AS slope, ROUND(regr_r2(value_num,
        tid), 6) + 0.0::DOUBLE AS r2, COUNT(*) AS points FROM qty GROUP BY 1, 2
    """,
    lambda f: rounded(temporal.trend(f.qty()), "slope", "r2").withColumns({n: F.col(n) + 0.0 for n in ("slope", "r2")}),
)
add(
    "temporal_anomalies",
    """
        SELECT dggid, tid, attr_key, value_num, ROUND((value_num - m) / sd, 6) AS z
        FROM (SELECT *, AVG(value_num) OVER (PARTITION BY dggid) m, STDDEV(value_num) OVER (PARTITION BY dggid) sd
        FROM qty) WHERE abs(value_num - m) > 2 * sd
    """,
    lambda f: rounded(temporal.anomalies(f.qty()), "z"),
)
add(
    "temporal_seasonal",
    """
        SELECT dggid, attr_key, tid % 2 AS season, ROUND(AVG(value_num), 6) AS season_mean,
        ROUND(AVG(value_num) - any_value(m), 6) AS seasonal FROM (SELECT *, AVG(value_num) OVER (PARTITION BY dggid) m
        FROM qty) GROUP BY 1, 2, 3
    """,
    lambda f: rounded(temporal.seasonal_means(f.qty(), 2), "season_mean", "seasonal"),
)
for _level in ("hour", "day", "week", "month"):
    add(
        f"temporal_bucket_{_level}",
        f"""
            SELECT attr_key, CAST(date_trunc('{_level}', ts) AS TIMESTAMP) AS bucket, COUNT(*) AS n,
            ROUND(AVG(value_num), 6) AS mean FROM evt GROUP BY 1, 2
        """,
        lambda f,
        level=_level: rounded(
            f.evt().groupBy(
                "attr_key",
                temporal.bucket(F.col("ts"), level).cast("timestamp_ntz").alias("bucket"),
            ).agg(F.count("*").alias("n"), F.avg("value_num").alias("mean")),
            "mean",
        ),
    )

# -- automata: fire from every 211th cell
_fire = lambda f: f.grid().select("dggid", F.when(F.col("k") % 211 == 0, "burning").otherwise("unburned").alias("state"))
add(
    "ca_step",
    """
        SELECT DISTINCT t.neighbor_dggid AS dggid FROM grid g JOIN topo t ON t.dggid = g.dggid
        WHERE g.k % 211 = 0 AND t.neighbor_dggid NOT IN (SELECT dggid FROM grid WHERE k % 211 = 0)
    """,
    lambda f: automata.ignite(_fire(f), f.topo()),
)
add(
    "ca_run_5",
    """
        WITH w AS (SELECT dggid, 0 AS d FROM grid WHERE k % 211 = 0 UNION SELECT t.neighbor_dggid, d + 1
        FROM w JOIN topo t ON t.dggid = w.dggid WHERE d < 5), m AS (SELECT dggid, MIN(d) d FROM w GROUP BY 1)
        SELECT grid.dggid, CASE WHEN d IS NULL THEN 'unburned' WHEN d = 5 THEN 'burning' ELSE 'burned' END AS state
        FROM grid LEFT JOIN m ON m.dggid = grid.dggid
    """,
    lambda f: automata.run(_fire(f), f.topo(), 5),
)

# -- annotations
add(
    "annotations_search",
    "SELECT id, dggid, visibility FROM ann WHERE content ILIKE '%tion the%'",
    lambda f: access.search_annotations(f.ann(), "tion the").select("id", "dggid", "visibility"),
)
add(
    "annotations_filter",
    """
        SELECT id, dggid, "type", visibility FROM ann WHERE visibility = 'public'
        AND "type" IN ('src1', 'src2', 'src3')
    """,
    lambda f: access.list_annotations(f.ann(), "public", ["src1", "src2", "src3"]).select("id", "dggid", "type", "visibility"),
)
add(
    "annotations_acl",
    """
        SELECT id, visibility FROM ann
        WHERE visibility = 'public' OR created_by = 'u3' OR (visibility = 'shared' AND id % 5 = 0)
    """,
    lambda f: access.visible_annotations(
        f.ann(),
        f.ann().where("id % 5 = 0").select(F.col("id").alias("annotation_id"), F.lit("u3").alias("user_id")),
        "u3",
    ).select("id", "visibility"),
)

# -- shapes, upkeep and calendars
_XY = """
    xy AS (SELECT dggid, q,
    r, 30.0::DOUBLE * pow(3.0::DOUBLE, -1.5::DOUBLE) * sqrt(3.0::DOUBLE) * (q + r / 2.0::DOUBLE) x,
    30.0::DOUBLE * pow(3.0::DOUBLE, -1.5::DOUBLE) * 1.5::DOUBLE * r y
    FROM grid), ll AS (SELECT dggid, x * cos(pi() / 2) - y * sin(pi() / 2) lon, degrees(asin(greatest(-1.0::DOUBLE,
    least(1.0::DOUBLE, radians(x * sin(pi() / 2) + y * cos(pi() / 2)))))) lat FROM xy)
"""
_points = lambda f: f.zone().withColumn("c", LATTICE.centroid(F.col("dggid"))).select("zone_id", "dggid", "c.lon", "c.lat")
add(
    "zone_centre",
    f"""
        WITH {_XY} SELECT zone_id, ROUND(AVG(lon), 5) + 0.0::DOUBLE AS lon, ROUND(AVG(lat), 5) + 0.0::DOUBLE AS lat,
        COUNT(*) AS cells FROM zone JOIN ll USING (dggid) GROUP BY 1
    """,
    lambda f: rounded(
        geometry.mean_centre(_points(f), ["zone_id"]),
        "lon",
        "lat",
        digits=5,
    ).withColumns({n: F.col(n) + 0.0 for n in ("lon", "lat")}),
)
add(
    "zone_box",
    f"""
        WITH {_XY}
        SELECT zone_id, ROUND(MIN(lon), 5) + 0.0::DOUBLE AS west, ROUND(MIN(lat), 5) + 0.0::DOUBLE AS south,
        ROUND(MAX(lon), 5) + 0.0::DOUBLE AS east, ROUND(MAX(lat), 5) + 0.0::DOUBLE AS north
        FROM zone JOIN ll USING (dggid) GROUP BY 1
    """,
    lambda f: rounded(
        geometry.bounding_box(_points(f), ["zone_id"]),
        "west",
        "south",
        "east",
        "north",
        digits=5,
    ).withColumns({n: F.col(n) + 0.0 for n in ("west", "south", "east", "north")}),
)
add(
    "label_summary",
    """
        SELECT zone_id AS value_text, COUNT(*) AS cells, ROUND(AVG(value_num), 6) AS mean
        FROM zone JOIN elev USING (dggid) GROUP BY 1
    """,
    lambda f: rounded(
        geometry.label_summary(
            f.zone().withColumnRenamed("zone_id", "value_text").join(f.elev().select("dggid", "value_num"), "dggid"),
        ),
        "mean",
    ),
)
add(
    "dataset_profile",
    """
        SELECT 'q' AS dataset_id, COUNT(*) AS rows, COUNT(DISTINCT dggid) AS cells,
        COUNT(DISTINCT attr_key) AS attributes, COUNT(DISTINCT tid) AS times FROM qty
    """,
    lambda f: catalog.profile(f.qty().withColumn("dataset_id", F.lit("q"))),
)
add(
    "health_counts",
    """
        SELECT (SELECT COUNT(*) FROM region) AS datasets, (SELECT COUNT(*) FROM qty) AS cells, (SELECT COUNT(*)
        FROM topo) AS topology
    """,
    lambda f: catalog.health(f.table("region"), f.qty(), f.topo()),
)
add(
    "cells_upsert",
    """
        SELECT COALESCE(b.dggid, a.dggid) AS dggid, COALESCE(b.value_num, a.value_num) AS value_num FROM q97 a FULL
        JOIN q98 b ON a.dggid = b.dggid
    """,
    lambda f: tables.upsert(_at0(f.qty(), 1997).select(*CELL), _at0(f.qty(), 1998).select(*CELL)).select("dggid", "value_num"),
)
add(
    "cells_records",
    """
        SELECT 'E' || CAST(event_id % 50 AS VARCHAR) AS dggid, event_id AS tid, event_type AS attr_key,
        value AS value_num FROM events
    """,
    lambda f: tables.parse_records(
        f.table("events").select(
            F.concat(F.lit("E"), (F.col("event_id") % 50).cast("string")).alias("zone"),
            F.col("event_id").alias("time"),
            F.col("event_type").alias("key"),
            F.col("value").alias("value"),
        ),
    ).select(*CELL),
)
_LOS = """
    o AS (SELECT value_num + 1.8::DOUBLE eye FROM elev
    WHERE dggid = 'C3-2-2'), t AS (SELECT g.dggid, g.q, g.r, e.value_num elevation,
    (abs(q - 2) + abs(r - 2) + abs(q - 2 + r - 2)) // 2 AS depth FROM grid g
    JOIN elev e ON e.dggid = g.dggid), n AS (SELECT t.*,
    j, 'C3-' || CAST(CAST(round(2 + (q - 2) * j / depth::DOUBLE) AS BIGINT) AS VARCHAR)
    || '-' || CAST(CAST(round(2 + (r - 2) * j / depth::DOUBLE) AS BIGINT) AS VARCHAR) AS here
    FROM t, range(1, 6) x(j) WHERE depth BETWEEN 1 AND 6
    AND j < depth), m AS (SELECT n.dggid, MAX((e.value_num - eye) / j) most FROM n JOIN elev e ON e.dggid = n.here, o
    GROUP BY 1)
"""
add(
    "viewshed_los_r6",
    f"""
        WITH {_LOS} SELECT t.dggid, CAST(depth AS BIGINT) AS depth, elevation,
        most IS NULL OR (elevation - eye) / depth >= most AS visible FROM t LEFT JOIN m ON m.dggid = t.dggid, o
        WHERE depth BETWEEN 1 AND 6
    """,
    lambda f: reach.line_of_sight(f.elev(), LATTICE, "C3-2-2", 1.8, 6),
)
