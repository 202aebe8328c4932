"""The catalogue of datasets, uploads and jobs as tables, and upkeep of the store."""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import identifier
from .operators.rollup import rollup_cells
from .schema import DATASETS
from .session import work_dir

STATUSES = ("processing", "active", "failed")


def new_dataset(spark: SparkSession, name: str, dggs: str, level: int | None = None, owner: str | None = None, metadata: dict | None = None, status: str = "active") -> DataFrame:
    """A catalogue row with a new id."""
    row = (str(uuid.uuid4()), name, None, dggs, level, owner, status, "private", [], json.dumps(metadata or {}), datetime.now(UTC).replace(tzinfo=None))
    return spark.createDataFrame([row], DATASETS)


def merge_metadata(datasets: DataFrame, dataset_id: str, patch: dict) -> DataFrame:
    """The catalogue with a patch's values that aren't null merged into one dataset's metadata; numbers, lists and objects stay what they are."""
    new = {k: v for k, v in patch.items() if v is not None}
    if not new:
        return datasets
    kind = "map<string,variant>"
    old = F.coalesce(F.from_json("metadata", kind), F.create_map().cast(kind))
    both = F.map_zip_with(old, F.from_json(F.lit(json.dumps(new)), kind), lambda k, a, b: F.coalesce(b, a))
    return datasets.withColumn("metadata", F.when(F.col("id") == dataset_id, F.to_json(both)).otherwise(F.col("metadata")))


def _of_operation(lower: bool) -> Column:
    """Whether the metadata name an operation as the source; `lower`: in any case."""
    hit = F.lit(False)
    for key in ("source", "source_type"):
        v = F.get_json_object("metadata", f"$.{key}")
        hit |= F.coalesce((F.lower(v) if lower else v).isin("spatial_op", "operation"), F.lit(False))
    return hit


def is_result() -> Column:
    """Whether a dataset is shown as a result: by its metadata's source, by a type together with a list of parents, or by its name."""
    parents, kind = F.get_json_object("metadata", "$.parents"), F.get_json_object("metadata", "$.type")
    derived = F.coalesce(kind.isNotNull() & ~kind.isin("", "0", "false", "null") & parents.startswith("["), F.lit(False))
    name = F.lower(F.coalesce("name", F.lit("")))
    return _of_operation(lower=True) | derived | name.contains(" result") | name.endswith("result")


def is_leftover() -> Column:
    """The wider rule by which a fresh start clears results: by source, by any parents, or by name."""
    return _of_operation(lower=False) | F.get_json_object("metadata", "$.parents").isNotNull() | F.coalesce(F.col("name").ilike("% result%"), F.lit(False))


def split_results(datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data, results) of the catalogue."""
    return datasets.where(~is_result()), datasets.where(is_result())


def expired(datasets: DataFrame, hours: int, now: Column | None = None) -> DataFrame:
    """Datasets older than so many hours whose metadata name an operation as their source; none if hours isn't positive."""
    if hours <= 0:
        return datasets.limit(0)
    at = F.current_timestamp() if now is None else now
    return datasets.where(_of_operation(lower=False) & (F.col("created_at") < at - F.make_interval(hours=F.lit(hours))))


def without_expired(datasets: DataFrame, cells: DataFrame, hours: int, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Catalogue and cells without expired results."""
    gone = expired(datasets, hours, now).select("id")
    return datasets.join(gone, "id", "left_anti"), cells.join(gone.withColumnRenamed("id", "dataset_id"), "dataset_id", "left_anti")


def health(datasets: DataFrame, cells: DataFrame, topology: DataFrame) -> DataFrame:
    """Row counts of the three tables, in one row."""
    counts = [t.agg(F.count("*").alias(n)) for n, t in (("datasets", datasets), ("cells", cells), ("topology", topology))]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))


def optimised(cells: DataFrame, name: str, key: str = "dggid", buckets: int = 16) -> DataFrame:
    """A copy of cells (or of a topology) as table `name`, bucketed and sorted by `key`: joins on it need no exchange of the copy.

    The files lie in the application's shared folder; an older table of that name is replaced.
    """
    spark = cells.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {identifier(name)}")
    at = f"{work_dir(spark)}/{identifier(name)}-{uuid.uuid4().hex}"
    cells.write.format("parquet").option("path", at).bucketBy(buckets, key).sortBy(key).saveAsTable(identifier(name))
    return spark.table(identifier(name))


def aggregated_copy(cells: DataFrame, parents: DataFrame, level: int, target: int, how: str = "mean", name: str | None = None) -> DataFrame:
    """Cells one step up, per attribute over all times (tid 0), as an optimised copy; the target must be coarser than the level."""
    if target >= level:
        raise ValueError("the target must be coarser than the cells")
    x = rollup_cells(cells.withColumn("tid", F.lit(0).cast("bigint")), parents, how)
    return optimised(x, name or f"cells_L{target}_{how}")


def profile(cells: DataFrame) -> DataFrame:
    """Per dataset: rows, distinct cells, attributes and times."""
    return cells.groupBy("dataset_id").agg(F.count("*").alias("rows"), F.countDistinct("dggid").alias("cells"), F.countDistinct("attr_key").alias("attributes"), F.countDistinct("tid").alias("times"))


def uploads_of(uploads: DataFrame, owner: str | None = None, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Uploads, of one user if given, newest first."""
    x = uploads if owner is None else uploads.where(F.col("created_by") == owner)
    x = x if status is None else x.where(F.col("status") == status)
    return x.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def active_page(datasets: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the active datasets, newest first, each with how many there are in all as number_matched."""
    active = datasets.where("status = 'active'")
    total = active.agg(F.count("*").alias("number_matched"))
    page = active.orderBy(F.col("created_at").desc_nulls_last(), "id").offset(offset).limit(min(max(limit, 1), 1000))
    return page.crossJoin(F.broadcast(total))


def explain_query(spark: SparkSession, sql: str) -> str:
    """The formatted plan of one SELECT; anything else is refused."""
    words = sql.lower().split()
    if not words or words[0] not in ("select", "with") or ";" in sql or set(words) & {"insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke"}:
        raise ValueError("only a single SELECT can be explained")
    return spark.sql(f"EXPLAIN FORMATTED {sql}").first()[0]


class TableCache:
    """Persisted DataFrames by name for a while. Lifetimes in seconds: topology and geometry a day, datasets an hour, statistics ten minutes, viewports five."""

    LIFETIMES = {"topology": 86_400, "geometry": 86_400, "dataset": 3_600, "stats": 600, "viewport": 300}

    def __init__(self, clock=time.monotonic):
        self.clock, self.held = clock, {}

    def get(self, kind: str, name: str, make) -> DataFrame:
        """The held DataFrame, or make() persisted anew where there is none or its time is over."""
        held = self.held.get((kind, name))
        if held and held[0] > self.clock():
            return held[1]
        self.drop(kind, name)
        df = make().persist()
        self.held[kind, name] = (self.clock() + self.LIFETIMES[kind], df)
        return df

    def drop(self, kind: str, name: str) -> None:
        held = self.held.pop((kind, name), None)
        if held:
            held[1].unpersist()
