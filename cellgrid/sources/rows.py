"""Tables whose rows change one by one: changes are files beside the parts that they touch, read together and compacted later."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..session import cut, dropped
from ..streaming.cells import current, name_version, names_in
from .tables import keyed

#: Where the version file keeps the columns.
COLUMNS = "columns"


class Rows:
    """A table at `path` with the primary key `keys`, dealt by a hash of the key over `parts` parts.

    One file names, for each part, the folder of its rows and those of the changes since, in order. A change writes only rows
    that changed, into the parts of their keys, and then the next version of that file, which is there whole or not at all: a
    writer that dies leaves the table as it was. Changes are made by one writer at a time. Null keys are not allowed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path, tuple(keys), parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts))

    def _state(self) -> tuple[int, dict[str, list[str]], StructType]:
        """The version, the folders of each part, and the columns."""
        version, folders = current(self.spark, self.path)
        if version < 0:
            raise ValueError(f"no rows at {self.path}")
        return version, folders, StructType.fromJson(json.loads(folders.pop(COLUMNS)[0]))

    def _add(self, rows: DataFrame, gone: bool, whole: Iterable[str] = ()) -> None:
        """Writes rows as the next change; the parts in `whole` consist of them alone from now on."""
        version, folders, columns = self._state()
        folder = f"{self.path}/parts/{version + 1}-{uuid.uuid4().hex}"
        x = rows.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in columns], F.lit(version + 1).cast("bigint").alias("_version"), F.lit(gone).alias("_gone"), self._part().alias("_part"))
        x.repartition("_part").write.partitionBy("_part").parquet(folder)
        after = {p: f for p, f in folders.items() if p not in set(whole)}
        for name in names_in(self.spark, folder):
            if name.startswith("_part="):
                part = name.removeprefix("_part=")
                after[part] = [*after.get(part, []), f"{folder}/{name}"]
        name_version(self.spark, self.path, version + 1, {**after, COLUMNS: [columns.json()]})

    def _together(self, folders: list[list[str]], columns: StructType) -> DataFrame:
        """The rows of some parts, each part given by its folders: rows without a later change, and the last change of every other."""
        reader = self.spark.read.schema(StructType([*columns, StructField("_version", LongType()), StructField("_gone", BooleanType())]))
        if not folders:
            return self.spark.createDataFrame([], columns)
        rows, later = reader.parquet(*[f[0] for f in folders]), [f for part in folders for f in part[1:]]
        if later:
            changes = reader.parquet(*later)
            value = F.struct(*[c for c in changes.columns if c not in self.keys])
            last = changes.groupBy(*self.keys).agg(F.max_by(value, "_version").alias("_last")).select(*self.keys, "_last.*")
            rows = rows.join(last.select(*self.keys), list(self.keys), "left_anti").unionByName(last)
        return rows.where("not _gone").select(*columns.names)

    def create(self, rows: DataFrame) -> Rows:
        """Writes the first rows; of rows with one key the greatest stays."""
        if current(self.spark, self.path)[0] >= 0:
            raise ValueError(f"there are rows at {self.path}")
        name_version(self.spark, self.path, 0, {COLUMNS: [rows.schema.json()]})
        self._add(self._one_of_each(rows), gone=False)
        return self

    def _one_of_each(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in self.keys]
        if not others:
            return rows.distinct()
        return rows.groupBy(*self.keys).agg(F.max(F.struct(*others)).alias("_r")).select(*self.keys, "_r.*")

    def read(self) -> DataFrame:
        """All rows."""
        _, folders, columns = self._state()
        return self._together(list(folders.values()), columns)

    def get(self, key: object) -> DataFrame:
        """The row with this key, if there is one, from the files of its part alone."""
        _, folders, columns = self._state()
        values = {k: F.lit(v).cast(columns[k].dataType) for k, v in keyed(self.keys, key).items()}
        part = str(self.spark.range(1).select(*[v.alias(k) for k, v in values.items()]).select(self._part()).first()[0])
        x = self._together([folders[part]] if part in folders else [], columns)
        return x.where(reduce(Column.__and__, [F.col(k) == v for k, v in values.items()]))

    def put(self, rows: DataFrame) -> None:
        """Rows with all columns, each instead of the row with its key or as a new one; of rows with one key the greatest stays."""
        self._add(self._one_of_each(rows.select(*self._state()[2].names)), gone=False)

    def update(self, key: object, changes: dict) -> None:
        """New values in the row with this key; nothing changes where there is none."""
        row = self.get(key)
        wrong = set(changes) - (set(row.columns) - set(self.keys))
        if wrong:
            raise ValueError(f"cannot change {sorted(wrong)}")
        self._add(row.withColumns({c: F.lit(v) for c, v in changes.items()}), gone=False)

    def remove(self, keys: DataFrame) -> None:
        """Takes out the rows with these keys; keys without a row are ignored."""
        others = {n: F.lit(None) for n in self._state()[2].names if n not in self.keys}
        self._add(keys.select(*self.keys).distinct().withColumns(others), gone=True)

    def compact(self, most: int = 8) -> list[str]:
        """Rewrites the parts with more than `most` changes, and no others; returns their numbers."""
        _, folders, columns = self._state()
        full = [p for p, f in folders.items() if len(f) > most + 1]
        if full:
            self._add(self._together([folders[p] for p in full], columns), gone=False, whole=full)
        return full


def summary(cells: DataFrame, groups: tuple[str, ...], value: str = "value_num") -> DataFrame:
    """What a kept roll-up needs to follow changes: per group n, total, least and most of the values that are not null."""
    x = cells.where(F.col(value).isNotNull())
    return x.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def refresh(copy: Rows, removed: DataFrame, added: DataFrame, now: DataFrame, value: str = "value_num") -> None:
    """Brings a kept `summary` up to date: `removed` and `added` are the cells that went and came, `now` all cells as they are.

    Only groups with changes are read and written. Counts and totals follow by differences; a least or greatest value is taken
    from `now` only in groups that lost theirs. Groups without values go. Totals of floating values may differ from a
    rebuild in the last digits, as any other order of addition.
    """
    groups = list(copy.keys)
    signed = summary(removed, copy.keys, value).withColumn("sign", F.lit(-1)).unionByName(summary(added, copy.keys, value).withColumn("sign", F.lit(1)))
    came = F.col("sign") > 0
    change = signed.groupBy(*groups).agg(
        F.sum(F.col("n") * F.col("sign")).alias("n_d"), F.sum(F.col("total") * F.col("sign")).alias("total_d"),
        F.min(F.when(came, F.col("least"))).alias("least_in"), F.max(F.when(came, F.col("most"))).alias("most_in"),
        F.min(F.when(~came, F.col("least"))).alias("least_out"), F.max(F.when(~came, F.col("most"))).alias("most_out"),
    )
    lost = (F.col("least_out") <= F.col("least")) | (F.col("most_out") >= F.col("most"))
    n, total = F.coalesce("n", F.lit(0)) + F.col("n_d"), F.coalesce("total", F.lit(0)) + F.col("total_d")
    x = change.join(copy.read(), groups, "left").select(
        *groups, n.alias("n"), total.alias("total"), F.least("least", "least_in").alias("least"), F.greatest("most", "most_in").alias("most"), F.coalesce(lost, F.lit(False)).alias("lost"),
    )
    x = cut(x, "refresh")
    again = summary(now.join(x.where("lost and n > 0").select(*groups), groups, "left_semi"), copy.keys, value).select(*groups, F.col("least").alias("least_now"), F.col("most").alias("most_now"))
    kept = x.where("n > 0").join(again, groups, "left")
    copy.put(kept.select(*groups, "n", "total", *[F.when(F.col("lost"), F.col(f"{c}_now")).otherwise(F.col(c)).alias(c) for c in ("least", "most")]))
    copy.remove(x.where("n <= 0"))
    dropped(x)
