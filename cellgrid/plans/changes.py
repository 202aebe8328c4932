"""Queries of rows that change one by one, and of roll-ups that follow changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, work_dir
from ..sources.rows import Rows, refresh, summary
from .fixtures import Fixtures
from .registry import add


def _rows(f: Fixtures, keys: tuple[str, ...], first: DataFrame) -> Rows:
    return Rows(f.spark, f"{work_dir(f.spark)}/rows-{uuid.uuid4().hex}", keys, parts=8).create(first)


def _changed(f: Fixtures) -> DataFrame:
    """The catalogue after a change to many rows, to one, the removal of many, and a rewrite of the parts with changes."""
    all_rows = f.datasets().select("id", "name", "status", F.col("id").cast("bigint").alias("k"))
    table = _rows(f, ("id",), all_rows)
    table.put(all_rows.where("k % 7 = 0").withColumn("status", F.lit("archived")))
    table.remove(all_rows.where("k % 11 = 0"))
    table.compact(most=1)
    table.update("5", {"name": "five"})
    return table.read()


add(
    "rows_changed",
    """
        SELECT id, CASE id WHEN '5' THEN 'five' ELSE "name" END AS "name", CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'archived' ELSE status END AS status,
        CAST(id AS BIGINT) AS k FROM ds WHERE CAST(id AS BIGINT) % 11 <> 0
    """,
    _changed,
)


def _refreshed(f: Fixtures) -> DataFrame:
    """The quantities' roll-up by parent, kept through a year that comes and one that goes."""
    cells = f.qty().join(f.parent(), "dggid").select("parent_dggid", "attr_key", "tid", "value_num")
    cells = cut(cells, "cells")
    groups = ("parent_dggid", "attr_key")
    copy = _rows(f, groups, summary(cells.where("tid <> 1995"), groups))
    refresh(copy, cells.where("tid = 1993"), cells.where("tid = 1995"), cells.where("tid <> 1993"))
    return copy.read().select(*groups, "n", (F.col("total") / F.col("n")).alias("mean"), "least", "most")


add(
    "rollup_refreshed",
    """
        SELECT parent_dggid, attr_key, COUNT(*) AS n, SUM(value_num) / COUNT(*) AS mean, MIN(value_num) AS least, MAX(value_num) AS most
        FROM qty JOIN parent USING (dggid) WHERE tid <> 1993 GROUP BY ALL
    """,
    _refreshed,
)
