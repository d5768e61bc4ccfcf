"""Helpers for joins and windows that Spark has no single operator for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.shared import stored


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the last in this order. Aggregated before the shuffle, so a hot key is no hot task."""
    best = df.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("row"))
    return best.select("row.*")


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def runs_by_gap(df: DataFrame, key: str, at: str, order: str, seconds: int, run: str = "run") -> DataFrame:
    """Gaps and islands: rows of a key whose neighbouring times are at most so many seconds apart get one run, named by its first row.

    Rows of one second are one run whatever their number, so each (key, second) is first summed up to one row with its least name,
    before the shuffle. Windows are over the seconds of a (key, day), 86,400 rows at most, and stitched at midnight: a run that goes on is
    recognised by the last time of the day before and takes that run's name, however many days it spans. Rows then look their second up.
    """
    second = F.unix_timestamp(at)
    name = F.struct(F.col(at).alias("at"), F.col(order).alias("id"))
    seconds_of = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, second.alias("_t")).agg(F.min(name).alias("_name")).withColumn("_day", F.to_date("_name.at"))
    w = Window.partitionBy(key, "_day").orderBy("_t")
    gap = F.col("_t") - F.lag("_t").over(w)
    seen = seconds_of.withColumn("_start", F.when(gap.isNull() | (gap > seconds), F.col("_name"))).withColumn("_run", F.last("_start", True).over(w))
    days = seen.groupBy(key, "_day").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.min("_run").alias("_head"), F.max("_run").alias("_tail"))
    over = Window.partitionBy(key).orderBy("_day")
    linked = F.coalesce(F.col("_first") - F.lag("_last").over(over) <= seconds, F.lit(False))
    # the run that a day's first rows go on with began in the nearest day before that isn't one unbroken, linked run
    whole = linked & (F.col("_head") == F.col("_tail"))
    days = days.withColumn("_linked", linked).withColumn("_origin", F.when(~whole, F.col("_tail")))
    days = days.withColumn("_from", F.last("_origin", True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    renamed = days.where("_linked").select(key, "_day", F.col("_head").alias("_run"), F.col("_from"))
    runs = seen.join(renamed, [key, "_day", "_run"], "left").select(key, "_t", F.coalesce("_from", "_run")["id"].alias(run))
    return df.withColumn("_t", second).join(runs, [key, "_t"], "left").drop("_t")


def nearest_k(left: DataFrame, right: DataFrame, left_value: str, right_value: str, right_id: str, width: int, k: int, rank: str = "rank") -> DataFrame:
    """Each left row beside its k nearest right rows by value, at most ``width`` apart, ties by right_id: at most k rows for a left row, whatever the values.

    Of right rows of one value only the k least ids can count, so values are looked for, each once: both sides' distinct values
    are range-partitioned together, and as the k next values to either side may lie in other partitions, each partition gets the k last
    right values before it and the k first behind it. Then every left value finds its neighbours in a sorted array.
    """
    spark = left.sparkSession
    first = top_k_per_key(right.where(F.col(right_value).isNotNull()), [right_value], [right_id], k, "_nth").drop("_nth")
    values = left.select(F.col(left_value).cast("long").alias("_v"), F.lit(True).alias("_asks"), F.lit(False).alias("_told")).where("_v is not null")
    values = values.unionByName(first.select(F.col(right_value).cast("long").alias("_v"), F.lit(False).alias("_asks"), F.lit(True).alias("_told")))
    values = values.groupBy("_v").agg(F.max("_asks").alias("_asks"), F.max("_told").alias("_told"))
    parted = stored(values.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()))
    edge = lambda order: top_k_per_key(parted.where("_told"), ["_part"], [order], k).select("_part", "_v")
    # to the driver: at most 2k values of each range partition
    told = edge(F.asc("_v")).unionByName(edge(F.desc("_v"))).distinct().collect()
    parts = [r[0] for r in parted.select("_part").distinct().collect()]
    every, carried = sorted((r["_part"], r["_v"]) for r in told), []
    for p in parts:
        carried += [(p, v, False, True) for _, v in [x for x in every if x[0] < p][-k:]] + [(p, v, False, True) for _, v in [x for x in every if x[0] > p][:k]]
    both = parted.select("_part", "_v", "_asks", "_told").unionByName(spark.createDataFrame(carried, "_part int, _v long, _asks boolean, _told boolean"))

    def neighbours(rows: pd.DataFrame) -> pd.DataFrame:
        asks, told = np.unique(rows["_v"][rows["_asks"]].to_numpy(np.int64)), np.unique(rows["_v"][rows["_told"]].to_numpy(np.int64))
        spot = np.searchsorted(told, asks)[:, None] + np.arange(-k, k)[None, :]
        fits = (spot >= 0) & (spot < len(told))
        pairs = pd.DataFrame({"_left": np.repeat(asks, fits.sum(1)), "_right": told[spot[fits]]})
        return pairs[(pairs["_left"] - pairs["_right"]).abs() <= width]

    pairs = both.groupBy("_part").applyInPandas(neighbours, "_left long, _right long")
    found = pairs.join(first, pairs["_right"] == first[right_value])
    best = top_k_per_key(found, ["_left"], [F.abs(F.col("_left") - F.col("_right")), right_id], k, rank).drop("_right")
    return left.join(best, left[left_value] == best["_left"]).drop("_left")


def asof_forward(rows: DataFrame, days: DataFrame, due: str, day: str, out: str, by: str | None = None) -> DataFrame:
    """Each row gets the first day at or after its due date, else the last day.

    Only distinct due dates are looked up, as many as the calendar has: they and the days become one table in which a window looks ahead,
    and rows then join their date's answer.
    """
    keys = [by] if by else []
    marks = days.select(*keys, F.col(day).alias("_at")).where("_at is not null").distinct()
    dates = rows.select(*keys, F.col(due).alias("_at")).where("_at is not null").distinct()
    both = dates.withColumn("_is_day", F.lit(0)).withColumn("_day", F.lit(None).cast("date")).unionByName(marks.withColumn("_is_day", F.lit(1)).withColumn("_day", F.col("_at")))
    group = keys or [F.lit(1)]
    ahead = Window.partitionBy(*group).orderBy("_at", "_is_day").rowsBetween(0, Window.unboundedFollowing)
    answers = both.withColumn("_next", F.coalesce(F.min("_day").over(ahead), F.max("_day").over(Window.partitionBy(*group)))).where("_is_day = 0").select(*keys, F.col("_at").alias(due), F.col("_next").alias(out))
    return rows.join(answers, [*keys, due], "left")


def running_sum(df: DataFrame, value: Column, by: str, order: list[str], out: str) -> DataFrame:
    """Running totals of each ``by`` group in two steps, so that one giant group is spread over tasks.

    Range partitions keep the order; totals of all earlier partitions (one row for each task and group) are added to the
    running totals within a partition.
    """
    parted = stored(df.withColumn("_v", value).repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    totals = parted.groupBy(by, "_part").agg(F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(by, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = parted.withColumn("_run", F.sum("_v").over(within)).join(totals, [by, "_part"])
    return found.withColumn(out, F.col("_run") + F.col("_base")).drop("_v", "_part", "_run", "_base")
