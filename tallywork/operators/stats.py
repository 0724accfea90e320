"""Exact statistics over groups of any size.

Inputs are first counted by value, so copies never travel more than once, and
no step holds a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Values per slice of the median search: the most rows one window of it can see per group.
SLICE = 1 << 14


def exact_median(counted: DataFrame, keys: Sequence[str], value: str, count: str, name: str) -> DataFrame:
    """Median of a whole-number column per group, as double, from rows (keys, value, count).

    Counts per slice of values find the slices that hold the middle ranks; only
    their rows are ordered. One window spans slices, the other the values of a
    slice, so a group with a third of all rows still spreads over many tasks.
    """
    keys = list(keys)
    sliced = counted.select(*keys, F.col(value).alias("v"), F.col(count).alias("n")).withColumn(
        "slice", F.floor(F.col("v") / SLICE)
    )
    per_slice = sliced.groupBy(*keys, "slice").agg(F.sum("n").alias("slice_n"))
    ordered = Window.partitionBy(*keys).orderBy("slice")
    middle = (
        per_slice.withColumn("before", F.sum("slice_n").over(ordered) - F.col("slice_n"))
        .withColumn("total", F.sum("slice_n").over(Window.partitionBy(*keys)))
        .withColumn("low_rank", F.floor((F.col("total") + 1) / 2))
        .withColumn("high_rank", F.floor(F.col("total") / 2) + 1)
        .filter((F.col("before") < F.col("high_rank")) & (F.col("before") + F.col("slice_n") >= F.col("low_rank")))
        .select(*keys, "slice", "before", "low_rank", "high_rank")
    )
    values = Window.partitionBy(*keys, "slice").orderBy("v")

    def at(rank: str):
        return F.max(F.when((F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("n") < F.col(rank)), F.col("v")))

    return (
        sliced.groupBy(*keys, "slice", "v").agg(F.sum("n").alias("n"))
        .join(middle, [*keys, "slice"])
        .withColumn("upto", F.col("before") + F.sum("n").over(values))
        .groupBy(*keys)
        .agg(((at("low_rank") + at("high_rank")) / 2).alias(name))
    )


def exact_mad(counted: DataFrame, keys: Sequence[str], value: str, count: str, median: str, name: str) -> DataFrame:
    """Median distance from the median. `counted` carries the group's median column.

    Distances are doubled while counted, so that half-step medians stay whole.
    """
    doubled = counted.withColumn("distance", F.abs(F.col(value) * 2 - F.col(median) * 2).cast("bigint"))
    return exact_median(doubled, keys, "distance", count, name).withColumn(name, F.col(name) / 2)


def day_gaps(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps between consecutive rows in date order, as (keys, gap, n).

    `days` has one row per (keys, posted_at) with count n; rows of one day are
    zero days apart. Days per group are bounded by the look-back.
    """
    order = Window.partitionBy(*keys).orderBy("posted_at")
    return (
        days.withColumn("gap", F.datediff("posted_at", F.lag("posted_at").over(order)))
        .withColumn("step", F.explode(F.array(
            F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("n")),
            F.struct(F.col("gap").alias("gap"), F.when(F.col("gap").isNotNull(), F.lit(1).cast("bigint")).alias("n")),
        )))
        .filter(F.col("step.n") > 0)
        .select(*keys, F.col("step.gap").alias("gap"), F.col("step.n").alias("n"))
    )
