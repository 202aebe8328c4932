"""Cell tables from CSV and JSON, and the Parquet store of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import typed_value
from ..schema import KEY, as_cells

#: Accepted names of each field, in order of preference.
ALIASES = {"dggid": ("dggid", "dggId", "zone"), "attr_key": ("attr_key", "key", "attribute", "attr"), "tid": ("tid", "time"), "raw": ("value", "value_text", "value_num", "value_json")}


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that is there and not blank."""
    have = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def parse_records(df: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Cell objects from records under any of the accepted names; a bad time counts as 0, and records without id or key go."""
    x = df.select(*[_first(df, names).alias(f) for f, names in ALIASES.items()]).where("dggid is not null and attr_key is not null")
    v = typed_value(F.col("raw"))
    return as_cells(x.select("dggid", F.coalesce(F.col("tid").try_cast("bigint"), F.lit(0).cast("bigint")).alias("tid"), "attr_key", *[c.alias(k) for k, c in v.items()]), dataset_id)


def read_csv(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    """Cells from CSV with a header."""
    return parse_records(spark.read.option("header", True).csv(path), dataset_id)


def read_json(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    """Cells from JSON: an array of records, or an object whose `cells` is one. Values that are objects or lists stay JSON."""
    x = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if "cells" in x.columns:
        x = x.select(F.explode("cells").alias("c")).select("c.*")
    nested = {n: F.to_json(n) for n, k in x.dtypes if k.startswith(("struct", "array", "map"))}
    return parse_records(x.withColumns(nested), dataset_id)


def read_json_lines(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    """Cells from newline-delimited JSON, one record a line, which Spark splits at any size."""
    x = spark.read.option("primitivesAsString", True).json(path)
    nested = {n: F.to_json(n) for n, k in x.dtypes if k.startswith(("struct", "array", "map"))}
    return parse_records(x.withColumns(nested), dataset_id)


def read_dataset(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    """The store, or one dataset of it: the literal id prunes to its partitions."""
    x = spark.read.parquet(path)
    return x if dataset_id is None else x.where(F.col("dataset_id") == dataset_id)


def write_dataset(cells: DataFrame, path: str, dataset_id: str) -> None:
    """A new dataset: partitions by dataset and attribute, sorted by id within files so that footers prune lookups."""
    as_cells(cells, dataset_id).repartition("dataset_id", "attr_key", F.pmod(F.xxhash64("dggid"), F.lit(16))).sortWithinPartitions("dggid", "tid").write.mode("append").partitionBy("dataset_id", "attr_key").parquet(path)


def upsert(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Old and new cell objects with one row per key, new before old; of several new ones the last by `order`."""
    keys = (["dataset_id"] if "dataset_id" in old.columns else []) + list(KEY)
    x = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    values = [F.desc_nulls_last(v) for v in ("value_num", "value_text", "value_json") if v in x.columns]
    last = Window.partitionBy(*keys).orderBy(F.desc("_turn"), *([F.desc(order)] if order else []), *values)
    return x.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_turn")


def insert_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and those new ones whose key is not there; of new ones with one key, the greatest value."""
    fresh = new.join(old.select(*KEY), list(KEY), "left_anti")
    return old.unionByName(upsert(fresh.limit(0), fresh), allowMissingColumns=True)


def _is(key: dict) -> Column:
    if not key:
        raise ValueError("a key is needed")
    same = F.lit(True)
    for name, value in key.items():
        same &= F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return same


def keyed(names: tuple[str, ...], values: object) -> dict:
    """A primary key as a dict: from one, from a tuple in the order of `names`, or, for a key of one column, from its value."""
    if isinstance(values, dict):
        if set(values) != set(names):
            raise ValueError(f"the key is {', '.join(names)}")
        return values
    values = values if isinstance(values, tuple | list) else (values,)
    if len(values) != len(names):
        raise ValueError(f"the key is {', '.join(names)}")
    return dict(zip(names, values, strict=True))


def get_row(table: DataFrame, key: dict) -> DataFrame:
    """The row with this key, if there is one."""
    return table.where(_is(key))


def update_row(table: DataFrame, key: dict, changes: dict) -> DataFrame:
    """The table with new values in the row with this key."""
    kinds = dict(table.dtypes)
    if not set(changes) <= set(kinds):
        raise ValueError(f"no columns {sorted(set(changes) - set(kinds))}")
    return table.withColumns({c: F.when(_is(key), F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in changes.items()})


def delete_row(table: DataFrame, key: dict) -> DataFrame:
    """The table without the row with this key."""
    return table.where(~_is(key))
