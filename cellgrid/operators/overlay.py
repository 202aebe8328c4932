"""Overlay and set operations: joins on (dggid, tid, attr_key) and on ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY

VALUES = ("value_text", "value_num", "value_json")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell objects in both: the mean where both are numbers, else a's value or b's."""
    y = b.select(*KEY, *[F.col(v).alias(f"b_{v}") for v in VALUES])
    x = a.join(y, list(KEY))
    number = F.when(F.col("value_num").isNotNull() & F.col("b_value_num").isNotNull(), (F.col("value_num") + F.col("b_value_num")) / 2).otherwise(F.coalesce("value_num", "b_value_num"))
    return x.select(*KEY, F.coalesce("value_text", "b_value_text").alias("value_text"), number.alias("value_num"), F.to_json(F.struct(F.col("value_num").alias("a"), F.col("b_value_num").alias("b"))).alias("value_json"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell objects of a whose key is not in b."""
    return a.join(b.select(*KEY), list(KEY), "left_anti").select(*KEY, *VALUES)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of a, and of b what a does not have."""
    return a.select(*KEY, *VALUES).unionByName(difference(b, a))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell objects in exactly one of the two."""
    return difference(a, b).unionByName(difference(b, a))


def clip(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cell objects in the mask's cells; the mask may repeat ids."""
    return cells.join(mask.select("dggid"), "dggid", "left_semi")


def merge_layers(*layers: DataFrame) -> DataFrame:
    """All rows of all layers."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), layers)


def _ids(sets: tuple[DataFrame, ...]) -> list[DataFrame]:
    if not sets:
        raise ValueError("at least one set is needed")
    return [s.select("dggid") for s in sets]


def ids_intersection(*sets: DataFrame) -> DataFrame:
    """Ids in every set."""
    return reduce(DataFrame.intersect, _ids(sets)).distinct()


def ids_union(*sets: DataFrame) -> DataFrame:
    """Ids in any set."""
    return reduce(DataFrame.union, _ids(sets)).distinct()


def ids_difference(*sets: DataFrame) -> DataFrame:
    """Ids of the first set in none of the others."""
    return reduce(DataFrame.subtract, _ids(sets)).distinct()
