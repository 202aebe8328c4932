"""Canonical schemas. A cell object is one attribute of one cell at one time; its value sits in one of three slots by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "dataset_id string, dggid string, tid bigint, attr_key string, value_text string, value_num double, value_json string"
TOPOLOGY = "dggid string, neighbor_dggid string, parent_dggid string, level int"
DATASETS = "id string, name string, description string, dggs_name string, level int, created_by string, status string, visibility string, shared_with array<string>, metadata string, created_at timestamp"
SHARES = "annotation_id bigint, user_id string"

#: What makes a cell object unique.
KEY = ("dggid", "tid", "attr_key")


def as_cells(df: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """`df` with all columns of the canonical schema, missing ones null, in its order."""
    have = set(df.columns)
    kinds = [c.strip().split(" ") for c in CELLS.split(",")]
    own = {"dataset_id": F.lit(dataset_id)} if dataset_id is not None else {}
    return df.select(*[(own.get(n) if n in own else F.col(n) if n in have else F.lit(None)).cast(k).alias(n) for n, k in kinds])
