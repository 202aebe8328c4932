"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from cellgrid.grid import HexLattice
from cellgrid.plans import catalogue
from cellgrid.sources import rasters

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"create view {t} as from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame, names):
    """Rows as text, sorted; NaN and missing values count as null."""
    out = []
    for r in frame[names].itertuples(index=False, name=None):
        out.append(str(tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r)))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, small, duck, name):
    got, want = catalogue.queries()[name](spark, small).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_has_rows(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[0] == "dggid" and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_regions_on_the_box_and_on_the_given_cells(spark, small, duck):
    got = {r.dggid: r.value_text for r in catalogue.queries()["demo_layer_regions"](spark, small).collect()}
    box = {r.dggid: r.value_text for r in rasters.demo_layer(spark, HexLattice(), rasters.DEMO_LAYERS[0]).collect()}
    cells = {d for (d,) in duck.execute("SELECT 'C3-' || p_partkey % 50 || '-' || p_partkey // 50 FROM part").fetchall()}
    assert len(box) > 50 and len(cells) > 50 and set(got) == set(box) | cells and box.items() <= got.items()
