"""Streams of readings to cell aggregates, with late data bounded by a watermark, merged into a stored table batch by batch."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import upsert

#: Times (tid) that lie in one part of the stored table: a day of hours.
PART_TIDS = 24
#: Version files that stay, so that the list of them does not grow with the batches.
VERSIONS = 20


def hourly_cells(readings: DataFrame, delay: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """Readings (ts, dggid, attr_key, value_num) as cell objects, one per window: the mean, with tid as the hour since the epoch."""
    w = readings.withWatermark("ts", delay).groupBy(F.window("ts", window), "dggid", "attr_key").agg(F.avg("value_num").alias("value_num"), F.count("*").alias("readings"))
    return w.select("dggid", (F.unix_timestamp(F.col("window.start")) / 3600).cast("bigint").alias("tid"), "attr_key", "value_num", "readings")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none where there is no such folder."""
    at, files = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def current(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(last batch, folder of each part) of the table at `path`, by its highest version file; (-1, {}) before the first batch."""
    names = [n for n in names_in(spark, f"{path}/versions") if n.endswith(".json")]
    if not names:
        return -1, {}
    text = spark.read.text(f"{path}/versions/{names[-1]}", wholetext=True).first()[0]
    return int(names[-1].removesuffix(".json")), json.loads(text)


def name_version(spark: SparkSession, path: str, batch_id: int, parts: dict[str, str] | dict[str, list[str]]) -> None:
    """Makes `parts` the table's current version, whole or not at all, and forgets versions older than the last few."""
    waiting, files = _files(spark, f"{path}/versions/.{batch_id}-{uuid.uuid4().hex}")
    out = files.create(waiting, False)
    out.write(bytearray(json.dumps(parts), "utf-8"))
    out.close()
    if not files.rename(waiting, _files(spark, f"{path}/versions/{batch_id:020d}.json")[0]):
        raise OSError(f"batch {batch_id} could not be named")
    for name in [n for n in names_in(spark, f"{path}/versions") if n.endswith(".json")][:-VERSIONS]:
        files.delete(_files(spark, f"{path}/versions/{name}")[0], False)


def merge_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Merges one batch into the table at `path` by key. A batch that comes again changes nothing.

    The table lies in parts by time, and only parts that the batch touches are written anew, each attempt into a folder of
    its own. Then one file names the folders of all parts: it is written under another name and renamed, so it is there
    whole or not at all. Whoever dies before that leaves the table as it was, and files that nobody reads.
    """
    spark = batch.sparkSession
    last, parts = current(spark, path)
    if last >= batch_id:
        return
    part = F.floor(F.col("tid") / PART_TIDS).cast("string")
    batch = batch.persist()
    try:
        touched = [r.part for r in batch.select(part.alias("part")).distinct().collect()]  # the days of one batch
        if touched:
            there = [parts[p] for p in touched if p in parts]
            old = spark.read.option("mergeSchema", True).parquet(*there) if there else batch.limit(0)
            merged_parts = upsert(old, batch)
            folder = f"{path}/parts/{batch_id}-{uuid.uuid4().hex}"
            merged_parts.withColumn("part", part).write.partitionBy("part").parquet(folder)
            parts |= {p: f"{folder}/part={p}" for p in touched}
    finally:
        batch.unpersist()
    name_version(spark, path, batch_id, parts)


def merge_batches(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts a query that merges each batch into the table at `path`; readers see whole batches only. With `once` it ends when all that is there is merged."""
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.foreachBatch(lambda batch, k: merge_batch(batch, k, path)).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last batch."""
    _, parts = current(spark, path)
    if not parts:
        raise ValueError(f"no batch has been merged at {path}")
    return spark.read.parquet(*sorted(parts.values()))


def remove_old(spark: SparkSession, path: str) -> None:
    """Deletes the folders and version files that the last version doesn't name; not while others read older versions."""
    last, parts = current(spark, path)
    named = [f for p in parts.values() for f in ([p] if isinstance(p, str) else p)]
    kept = {"/".join(f.rsplit("/", 2)[-2:]) for f in named}
    at, files = _files(spark, f"{path}/parts")
    for batch in files.listStatus(at) if files.exists(at) else []:
        for part in files.listStatus(batch.getPath()):
            if f"{batch.getPath().getName()}/{part.getPath().getName()}" not in kept:
                files.delete(part.getPath(), True)
    at, files = _files(spark, f"{path}/versions")
    for f in files.listStatus(at):
        if f.getPath().getName() != f"{last:020d}.json":
            files.delete(f.getPath(), False)
