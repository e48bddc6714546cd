"""Numbering the rows of a key without gathering the whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_time(df: DataFrame, key: str, epoch: Column, order: list[Column], name: str,
                 bucket_seconds: int = 86_400) -> DataFrame:
    """Add ``name`` = 0, 1, 2 ... per ``key`` in the order ``(epoch, *order)``.

    Rows are counted per (key, time bucket), the counts are summed along the
    buckets, and rows are numbered inside their bucket only.  The window over a
    whole key therefore sees one row per bucket: its size follows the time span,
    not the number of rows of the key.
    """
    bucketed = df.withColumn("_bucket", F.floor(epoch / bucket_seconds))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .select(key, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(epoch, *order)
    return (
        bucketed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, [key, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_place") - 1)
        .drop("_bucket", "_place", "_offset")
    )
