"""Operators over time. `tid` is an ordered integer; levels and calendars enter only where named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ten levels of the temporal hierarchy, from 0, with what they say and the calendar's unit of each.
LEVELS = {
    "instantaneous": ("Single moment in time, no aggregation", None),
    "minutely": ("Data aggregated to minute-level resolution", "minute"),
    "hourly": ("Data aggregated to hourly resolution", "hour"),
    "daily": ("Data aggregated to daily resolution", "day"),
    "weekly": ("Data aggregated to weekly resolution", "week"),
    "monthly": ("Data aggregated to monthly resolution", "month"),
    "yearly": ("Data aggregated to yearly resolution", "year"),
    "decade": ("Data aggregated to decade-level resolution", "decade"),
    "century": ("Data aggregated to century-level resolution", "century"),
    "millennium": ("Data aggregated to millennium-level resolution", "millennium"),
}
AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def hierarchy(spark: SparkSession) -> DataFrame:
    """The levels by number, with their names and descriptions."""
    rows = [(k, name, text) for k, (name, (text, _)) in enumerate(LEVELS.items())]
    return spark.createDataFrame(rows, "level int, name string, description string")


def bucket(ts: Column, level: str) -> Column:
    """The start of the bucket that holds a time, by a level's name or unit; decades and longer start at the era's first year."""
    units = {name: unit for name, (_, unit) in LEVELS.items()} | {unit: unit for _, unit in LEVELS.values() if unit}
    if level not in units:
        raise ValueError(f"unknown level {level}")
    return ts if units[level] is None else F.date_trunc(units[level], ts)


def snapshot(cells: DataFrame, tid: int) -> DataFrame:
    """Each cell's and attribute's last cell object at or before `tid`, in all the slots of a value that `cells` has."""
    slots = [v for v in ("value_num", "value_text", "value_json") if v in cells.columns]
    last = cells.where(F.col("tid") <= tid).groupBy("dggid", "attr_key").agg(F.max_by(F.struct("tid", *slots), "tid").alias("m"))
    return last.select("dggid", "attr_key", "m.tid", *[f"m.{v}" for v in slots])


def next_tid(tid: int, most: int) -> int:
    """The time that a player shows after `tid`: after the last one it starts again at 0."""
    return (tid + 1) % (most + 1)


def time_range(cells: DataFrame, start: int, end: int, keys: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Cell objects between two times, both included; `limit` cuts after ordering."""
    x = cells.where(F.col("tid").between(start, end))
    if keys:
        x = x.where(F.col("attr_key").isin(keys))
    return x if limit is None else x.orderBy("dggid", "tid", "attr_key").limit(min(limit, 10_000))


def temporal_aggregate(cells: DataFrame, start: int, end: int, how: str = "mean", target: int | None = None) -> DataFrame:
    """One value per cell and attribute over a range of times: mean, sum, min, max, count, or the first or last in time."""
    x = cells.where(F.col("tid").between(start, end) & F.col("value_num").isNotNull())
    if how == "first":
        f = F.min_by("value_num", "tid")
    elif how == "last":
        f = F.max_by("value_num", "tid")
    elif how in AGGREGATES:
        f = AGGREGATES[how]("value_num")
    else:
        raise ValueError(f"unknown aggregate {how}")
    return x.groupBy("dggid", "attr_key").agg(f.cast("double").alias("value_num")).select("dggid", F.lit(end if target is None else target).cast("bigint").alias("tid"), "attr_key", "value_num")


def temporal_difference(a: DataFrame, b: DataFrame, tid_a: int, tid_b: int) -> DataFrame:
    """b at one time minus a at another per cell and attribute; null, with `sides`, where only one has a value."""
    x = a.where(F.col("tid") == tid_a).select("dggid", "attr_key", F.col("value_num").alias("va"))
    y = b.where(F.col("tid") == tid_b).select("dggid", "attr_key", F.col("value_num").alias("vb"))
    z = x.join(y, ["dggid", "attr_key"], "full_outer")
    return z.select("dggid", "attr_key", (F.col("vb") - F.col("va")).alias("diff"), F.when(F.col("va").isNull(), "after only").when(F.col("vb").isNull(), "before only").otherwise("both").alias("sides"))


def timeseries(cells: DataFrame, dggid: str, key: str, start: int | None = None, end: int | None = None, labels: dict[int, str] | None = None) -> DataFrame:
    """One cell's values of an attribute in time order, with the granularity that each time stands for: by `labels`, else the level of that number, else unknown."""
    x = cells.where((F.col("dggid") == dggid) & (F.col("attr_key") == key))
    if start is not None:
        x = x.where(F.col("tid") >= start)
    if end is not None:
        x = x.where(F.col("tid") <= end)
    names = F.create_map(*[F.lit(v) for kv in (dict(enumerate(LEVELS)) if labels is None else labels).items() for v in kv])
    granularity = F.coalesce(F.try_element_at(names, F.col("tid").cast("int")), F.lit("unknown"))
    slots = [v for v in ("value_num", "value_text") if v in cells.columns]
    return x.select("tid", granularity.alias("granularity"), *slots).orderBy("tid")


def moving_average(cells: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """The mean over the neighbouring times of each cell and attribute, by rows."""
    w = Window.partitionBy("dggid", "attr_key").orderBy("tid").rowsBetween(-before, after)
    return cells.select("dggid", "tid", "attr_key", F.avg("value_num").over(w).alias("moving_avg"))


def trend(cells: DataFrame) -> DataFrame:
    """Slope and fit of a line through each cell's values over time."""
    return cells.where("value_num is not null").groupBy("dggid", "attr_key").agg(F.regr_slope("value_num", F.col("tid").cast("double")).alias("slope"), F.regr_r2("value_num", F.col("tid").cast("double")).alias("r2"), F.count("*").alias("points"))


def anomalies(cells: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Values more than so many sample deviations from their cell's mean."""
    w = Window.partitionBy("dggid", "attr_key")
    x = cells.where("value_num is not null").withColumn("m", F.avg("value_num").over(w)).withColumn("sd", F.stddev("value_num").over(w))
    return x.where(F.abs(F.col("value_num") - F.col("m")) > deviations * F.col("sd")).select("dggid", "tid", "attr_key", "value_num", ((F.col("value_num") - F.col("m")) / F.col("sd")).alias("z"))


def seasonal_means(cells: DataFrame, period: int) -> DataFrame:
    """Mean of each season (tid modulo the period) and its distance from the cell's overall mean."""
    x = cells.where("value_num is not null").withColumn("season", F.pmod("tid", F.lit(period)))
    by = x.groupBy("dggid", "attr_key", "season").agg(F.avg("value_num").alias("season_mean"), F.sum("value_num").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("dggid", "attr_key")
    return by.withColumn("seasonal", F.col("season_mean") - F.sum("s").over(w) / F.sum("n").over(w)).drop("s", "n")
