"""Work tables: how loops cut their lineage, and who removes their files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """This application's folder under the one that driver and executors share (spark.checkpoint.dir); it goes when the driver ends.

    Where the setting is missing, a local session gets a folder of its own; on a cluster that is an error, since executors
    would each write to their own disk.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="cellgrid-")
        spark.conf.set("spark.checkpoint.dir", shared)
    folder = f"{shared.rstrip('/')}/cellgrid-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return folder


def cut(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """`df` written to the shared folder and read again, so that a loop's plan stays short and a lost executor loses nothing."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_seen(df: DataFrame, *seen: Column, name: str = "step") -> tuple[DataFrame, dict]:
    """`df` as by `cut`, and what aggregates over its rows give, gathered while it is written: no second job."""
    watch = Observation()
    out = cut(df.observe(watch, *seen), name)
    return out, watch.get


def dropped(*tables: DataFrame) -> None:
    """Deletes the files behind tables made by `cut` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def running_total(df: DataFrame, order: str, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of `value` over all rows of its group `by` up to each one by `order` (distinct values), without one task for a whole group.

    Rows are dealt by ranges and written, so that the ranges stay what they are; each range is summed, the few sums of a
    group are added up in order, and each range adds its own start. Null groups are groups.
    """
    ranges = [F.col(c).asc_nulls_first() for c in (*by, order)]
    x = cut(df.repartitionByRange(*ranges).withColumn("_part", F.spark_partition_id()))
    group = [F.col(c) for c in by] or [F.lit(0)]
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_sum")
    sums = x.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    parts = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), before.alias("_start"))
    same = F.col("_part") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    in_part = Window.partitionBy(*by, "_part").orderBy(F.col(order).asc_nulls_first())
    upto = F.sum(value).over(in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn("_upto", upto).join(parts, same).select(*df.columns, (F.col("_start") + F.col("_upto")).alias(name))
