"""Attribute queries on cell objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 5000
AGGREGATES = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def clamp_limit(limit: int | None, most: int = MOST_ROWS) -> int:
    """A page's size: at least 1, at most `most`."""
    return min(max(limit or 1, 1), most)


def as_number(value: object) -> float | None:
    """The number that a filter value stands for (a number or a numeric string), else None."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def attribute(cells: DataFrame, key: str, tid: int | None = None) -> DataFrame:
    """(dggid, tid, value_num) of one attribute's numeric values, at one time if given: the pruned scan behind every operator."""
    out = cells.where((F.col("attr_key") == key) & F.col("value_num").isNotNull())
    return (out if tid is None else out.where(F.col("tid") == tid)).select("dggid", "tid", "value_num")


def range_query(cells: DataFrame, key: str, low: float | None = None, high: float | None = None, limit: int | None = None) -> DataFrame:
    """Cells whose value lies in a closed range; one bound may be missing, not both."""
    if low is None and high is None:
        raise ValueError("a range needs a bound")
    out = cells.where(F.col("attr_key") == key)
    if low is not None:
        out = out.where(F.col("value_num") >= low)
    if high is not None:
        out = out.where(F.col("value_num") <= high)
    return page(out, limit)


def filter_query(cells: DataFrame, key: str, value: object, op: str | None = "eq", limit: int | None = None) -> DataFrame:
    """Cells whose value equals a number (or numeric string), or else a text."""
    if op not in (None, "eq"):
        raise ValueError(f"unknown comparison {op}")
    number = as_number(value)
    same = F.col("value_num") == number if number is not None else F.col("value_text") == str(value)
    return page(cells.where((F.col("attr_key") == key) & same), limit)


def page(cells: DataFrame, limit: int | None = None, offset: int = 0, most: int = MOST_ROWS) -> DataFrame:
    """A page in the order of (dggid, tid, attr_key); without a limit, everything."""
    if limit is None and not offset:
        return cells
    out = cells.orderBy("dggid", "tid", "attr_key")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(clamp_limit(limit, most))


def list_cells(cells: DataFrame, key: str | None = None, prefix: str | None = None, tid: int | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """A page of cells by attribute, literal id prefix and time."""
    if key is not None:
        cells = cells.where(F.col("attr_key") == key)
    if prefix:
        cells = cells.where(F.col("dggid").startswith(prefix))
    if tid is not None:
        cells = cells.where(F.col("tid") == tid)
    return page(cells, limit, offset)


def lookup(cells: DataFrame, ids: DataFrame, key: str | None = None, tid: int | None = None) -> DataFrame:
    """Cells with one of the ids (a DataFrame with dggid): the map's viewport query."""
    if key is not None:
        cells = cells.where(F.col("attr_key") == key)
    if tid is not None:
        cells = cells.where(F.col("tid") == tid)
    return cells.join(ids.select("dggid").distinct(), "dggid", "left_semi")


def aggregate(cells: DataFrame, key: str, how: str = "avg") -> DataFrame:
    """One value per cell over all times."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how}")
    return cells.where(F.col("attr_key") == key).groupBy("dggid").agg(AGGREGATES[how]("value_num").alias("value"))


def pivot_attributes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell and time, one column per attribute: a conditional aggregate, one shuffle."""
    return cells.where(F.col("attr_key").isin(keys)).groupBy("dggid", "tid").agg(*[F.max(F.when(F.col("attr_key") == k, F.col("value_num"))).alias(k) for k in keys])


def map_algebra(cells: DataFrame, keys: list[str], expression: Column | str, name: str = "value_num") -> DataFrame:
    """An expression over attributes of the same cell and time."""
    e = F.expr(expression) if isinstance(expression, str) else expression
    return pivot_attributes(cells, keys).select("dggid", "tid", e.alias(name))


def search_datasets(datasets: DataFrame, text: str | None = None, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Datasets whose name holds `text` literally in any case, newest first."""
    if text:
        datasets = datasets.where(F.lower("name").contains(text.lower()))
    if status:
        datasets = datasets.where(F.col("status") == status)
    out = datasets.orderBy(F.col("created_at").desc_nulls_last(), "id").offset(offset)
    return out if limit is None else out.limit(clamp_limit(limit))


def zone_attributes(cells: DataFrame) -> DataFrame:
    """Per cell a map from attribute to its values at the last time."""
    last = cells.groupBy("dggid", "attr_key").agg(F.max_by(F.struct("tid", "value_num", "value_text", "value_json"), F.struct("tid", "value_num", "value_text")).alias("v"))
    return last.groupBy("dggid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr_key", "v")))).alias("attributes"))


def level_histogram(cells: DataFrame, level: Column) -> DataFrame:
    """How many distinct cells a dataset has at each level."""
    return cells.select("dggid").distinct().groupBy(level.alias("level")).agg(F.count("*").alias("cells"))
