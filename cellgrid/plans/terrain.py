"""Queries of isolines, drainage basins and filled depressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, isolines
from .registry import add, rounded

_LOW = "low AS (SELECT dggid, arg_min(neighbor, (v_n, neighbor)) AS target FROM nb WHERE v_n < v GROUP BY dggid)"

add(
    "drainage_basins",
    f"""
        WITH {_LOW},
        way AS (SELECT dggid, dggid AS sink FROM q97 UNION ALL SELECT w.dggid, l.target FROM way w JOIN low l ON l.dggid = w.sink)
        SELECT w.dggid, w.sink FROM way w LEFT JOIN low l ON l.dggid = w.sink WHERE l.dggid IS NULL
    """,
    lambda f: flow.basins(f.year(1997), f.topo()),
)
add(
    "filled_depressions",
    """
        WITH edge AS (SELECT a.dggid, any_value(a.value_num) AS v FROM q97 a LEFT JOIN nb ON nb.dggid = a.dggid
        GROUP BY a.dggid HAVING COUNT(nb.neighbor) < 6),
        flood AS (SELECT dggid, v AS level FROM edge
        UNION SELECT n.neighbor, greatest(f.level, n.v_n) FROM flood f JOIN nb n ON n.dggid = f.dggid)
        SELECT q.dggid, q.value_num AS elevation, MIN(f.level) AS filled, MIN(f.level) - q.value_num AS depth
        FROM q97 q LEFT JOIN flood f ON f.dggid = q.dggid GROUP BY q.dggid, q.value_num
    """,
    lambda f: flow.fill_depressions(f.year(1997), f.topo()),
)
add(
    "isolines",
    """
        WITH span AS (SELECT MIN(value_num) lo, MAX(value_num) hi FROM q97),
        cuts AS (SELECT CAST(k.v AS INT) AS level, lo + (hi - lo) * k.v / 3 AS threshold FROM span, range(1, 3) k(v)),
        cell AS (SELECT g.q, g.r, g.dggid, a.value_num v FROM grid g JOIN q97 a ON a.dggid = g.dggid),
        corner AS (SELECT a.dggid ai, a.v av, a.q aq, a.r ar, b.dggid bi, b.v bv, b.q bq, b.r br, c.dggid ci, c.v cv, c.q cq, c.r cr
        FROM (VALUES (0, 0, 1, 0, 0, 1), (1, 0, 1, 1, 0, 1)) t(aq, ar, bq, br, cq, cr) CROSS JOIN (SELECT q, r FROM cell UNION SELECT q - 1, r FROM cell) o
        JOIN cell a ON a.q = o.q + t.aq AND a.r = o.r + t.ar JOIN cell b ON b.q = o.q + t.bq AND b.r = o.r + t.br JOIN cell c ON c.q = o.q + t.cq AND c.r = o.r + t.cr),
        side AS (SELECT row_number() OVER () AS no, * FROM corner),
        sides AS (SELECT no, ai pi, av pv, aq pq, ar pr, bi si, bv sv, bq sq, br sr FROM side UNION ALL SELECT no, bi, bv, bq, br, ci, cv, cq, cr FROM side
        UNION ALL SELECT no, ci, cv, cq, cr, ai, av, aq, ar FROM side),
        falls AS (SELECT no, level, threshold, pi || '>' || si AS v, pq + (sq - pq) * (pv - threshold) / (pv - sv) AS x, pr + (sr - pr) * (pv - threshold) / (pv - sv) AS y
        FROM sides, cuts WHERE pv >= threshold AND sv < threshold),
        rises AS (SELECT no, level, threshold, si || '>' || pi AS v, sq + (pq - sq) * (sv - threshold) / (sv - pv) AS x, sr + (pr - sr) * (sv - threshold) / (sv - pv) AS y
        FROM sides, cuts WHERE sv >= threshold AND pv < threshold),
        links AS (SELECT a.level, a.v, b.v AS nxt FROM falls a JOIN rises b ON a.no = b.no AND a.level = b.level),
        points AS (SELECT level, v, any_value(threshold) threshold, any_value(x) x, any_value(y) y FROM (SELECT * FROM falls UNION ALL SELECT * FROM rises) GROUP BY level, v),
        finish AS (SELECT p.level, p.v, FALSE AS closed FROM points p LEFT JOIN links l ON l.level = p.level AND l.v = p.v WHERE l.v IS NULL),
        opened AS (SELECT level, v, v AS line, 0 AS remaining FROM finish
        UNION ALL SELECT o.level, l.v, o.line, o.remaining + 1 FROM opened o JOIN links l ON l.level = o.level AND l.nxt = o.v),
        rest AS (SELECT l.* FROM links l LEFT JOIN opened o ON o.level = l.level AND o.v = l.v WHERE o.v IS NULL),
        reach AS (SELECT level, v, v AS u FROM rest UNION SELECT r.level, r.v, l.nxt FROM reach r JOIN rest l ON l.level = r.level AND l.v = r.u),
        least AS (SELECT level, MIN(u) AS v FROM reach GROUP BY level, reach.v),
        rings AS (SELECT DISTINCT level, v, v AS line, 0 AS remaining FROM least
        UNION ALL SELECT o.level, l.v, o.line, o.remaining + 1 FROM rings o JOIN rest l ON l.level = o.level AND l.nxt = o.v AND l.v <> o.line)
        SELECT p.level, ROUND(p.threshold, 6) AS threshold, o.line, o.closed, CAST(o.remaining AS BIGINT) AS remaining, ROUND(p.x, 6) AS x, ROUND(p.y, 6) AS y
        FROM points p JOIN (SELECT *, FALSE AS closed FROM opened UNION ALL SELECT *, TRUE AS closed FROM rings) o ON o.level = p.level AND o.v = p.v
    """,
    lambda f: rounded(
        isolines.isolines(f.year(1997), f.topo(), f.grid().select("dggid", F.col("q").cast("double").alias("x"), F.col("r").cast("double").alias("y")), 3),
        "threshold", "x", "y",
    ),
)
