"""Exact medians of groups of any size, by counting in ranges of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.session import cut_lineage

# Ranges a group's values are counted in at a time.
RANGES = 16_384


def exact_medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """The median of ``value`` per ``keys``, the mean of the two middle values where their number is even.

    Values of a group are counted in equal ranges between its extremes, combined before the
    shuffle, and only the values of the range that holds a middle rank are looked at again,
    in finer ranges, until they are all equal.  A task thus never sees more of a group than its
    counts.  Where the two middle ranks fall into different ranges, they are the largest value of
    the one and the smallest of the other.  A null or NaN value makes a group's median NULL.
    """
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    named = [F.col(k).alias(f"_{k}") for k in keys]
    plain = cut_lineage(values.select(*keys, F.col("value").cast("double").alias("value")))
    groups = cut_lineage(plain.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.bool_or(F.col("value").isNull() | F.isnan("value")).alias("unknown")))
    wanted = groups.where("not unknown").select(
        *keys, "low", "high", F.explode(F.array_distinct(F.array(
            F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))).alias("rank"), F.lit(0).cast("long").alias("below"))
    done = []
    while True:
        wanted = cut_lineage(wanted)
        done.append(wanted.where("low = high").select(*keys, F.col("low").alias("value"), "rank"))
        wanted = wanted.where("low < high")
        if wanted.isEmpty():
            break
        range_of = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))
        asked = wanted.select(*named, "low", "high", "rank", "below")
        counted = (
            plain.join(asked, same).where("value between low and high").groupBy(*keys, "rank", "below", range_of.alias("part"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))
        so_far = Window.partitionBy(*keys, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        up_to = F.col("below") + F.sum("n").over(so_far)
        wanted = counted.withColumn("up_to", up_to).where(
            (F.col("rank") <= F.col("up_to")) & (F.col("rank") > F.col("up_to") - F.col("n"))).select(
            *keys, "low", "high", "rank", (F.col("up_to") - F.col("n")).alias("below"))
    middle = reduce(DataFrame.unionByName, done).groupBy(*keys).agg((0.5 * (F.min("value") + F.max("value"))).alias("median"))
    return groups.select(*keys).join(middle.select(*named, "median"), same, "left").select(*keys, "median")
