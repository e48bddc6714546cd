"""Checks and preparation of pings."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.schema import require_columns
from dwellpath.session import require_utc


def _inside(column: str, bound: int) -> Column:
    """Strictly between -bound and bound; NULL and NaN are outside."""
    value = F.col(column)
    return F.coalesce((value > -bound) & (value < bound), F.lit(False))


def validation_report(pings: DataFrame) -> DataFrame:
    """B1: one row per rule with the number of offending pings.

    ``time_order`` counts pings without a whole second to their predecessor.  Epochs
    are whole seconds, so after sorting these are exactly the repeats of a
    (user, second); no window over a user is needed.  ``user_known`` and ``time_known``
    count pings without a user or a time, which have no order.
    """
    require_columns(pings, "user_id", "epoch_time", "lat", "lon")
    report = (
        pings.groupBy("user_id", "epoch_time")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~_inside("lat", 90)).alias("bad_lat"),
            F.count_if(~_inside("lon", 180)).alias("bad_lon"),
        )
        .agg(
            F.sum("rows").alias("pings"),
            F.sum("bad_lat").alias("lat_range"),
            F.sum("bad_lon").alias("lon_range"),
            F.sum(F.when(F.col("user_id").isNotNull() & F.col("epoch_time").isNotNull(), F.col("rows") - 1)).alias("time_order"),
            F.sum(F.when(F.col("user_id").isNull(), F.col("rows"))).alias("user_known"),
            F.sum(F.when(F.col("epoch_time").isNull(), F.col("rows"))).alias("time_known"),
        )
    )
    return report.select(
        F.explode(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.coalesce(F.col(rule), F.lit(0)).alias("violations"),
                     F.coalesce(F.col("pings"), F.lit(0)).alias("pings"))
            for rule in ("lat_range", "lon_range", "time_order", "user_known", "time_known")
        ])).alias("r")
    ).select("r.*")


def validate_pings(pings: DataFrame, mode: str = "fail") -> DataFrame:
    """B1: keep only valid pings (``drop``) or stop the job at an invalid one (``fail``).

    Coordinates must lie strictly inside their range; user and time must be known.  Both
    modes are filters evaluated during the scan, so neither is lost when a plan reads no
    coordinates.
    """
    require_columns(pings, "lat", "lon")
    known = [name for name in ("user_id", "epoch_time") if name in pings.columns]
    valid = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in known], _inside("lat", 90) & _inside("lon", 180))
    if mode == "drop":
        return pings.where(valid)
    if mode == "fail":
        shown = [F.coalesce(F.col(name).cast("string"), F.lit("null")) for name in (*known, "lat", "lon")]
        message = F.concat(F.lit("invalid ping: "), F.concat_ws(", ", *shown))
        return pings.where(valid | F.raise_error(message).cast("boolean"))
    raise ValueError(f"mode must be 'fail' or 'drop', not {mode!r}")


def localise(pings: DataFrame, zones: DataFrame) -> DataFrame:
    """B2: shift ``epoch_time`` to the wall clock of the ping's country.

    ``zones`` has one row per country; countries without a zone stay in UTC.  The
    join carries no hint: Spark broadcasts the table while it is small and falls
    back to a shuffle join if a caller passes a large one.
    """
    require_utc(pings.sparkSession)
    require_columns(pings, "country", "epoch_time")
    require_columns(zones, "country", "timezone")
    local = F.from_utc_timestamp(F.timestamp_seconds("epoch_time"), F.coalesce(F.col("timezone"), F.lit("UTC")))
    return (
        pings.join(zones.select("country", "timezone"), "country", "left")
        .withColumn("epoch_time", F.unix_seconds(local))
    )


def most_observed_users(pings: DataFrame) -> DataFrame:
    """The user with most pings per country, and the place of their first ping.

    Pings are counted per user, one user per country is chosen from the counts, and only
    that user's pings are looked at for the first; ties go to the lower id.  Aggregations
    are on plain values, so nothing is sorted.
    """
    require_columns(pings, "country", "user_id", "epoch_time", "ping_id", "lat", "lon")
    counted = pings.groupBy("country", "user_id").agg(F.count(F.lit(1)).alias("observations"))
    most = counted.groupBy("country").agg(F.max("observations").alias("observations"))
    same = F.col("c.country").eqNullSafe(F.col("m.country")) & (F.col("c.observations") == F.col("m.observations"))
    top = counted.alias("c").join(most.alias("m"), same, "left_semi").groupBy("country", "observations").agg(
        F.min("user_id").alias("user_id"))
    mine = F.col("p.country").eqNullSafe(F.col("t.country")) & F.col("p.user_id").eqNullSafe(F.col("t.user_id"))
    theirs = pings.alias("p").join(top.alias("t"), mine).select("t.country", "t.user_id", "observations", *[
        F.col(f"p.{name}") for name in ("epoch_time", "ping_id", "lat", "lon")])
    order = F.col("epoch_time").cast("decimal(20,0)") * F.lit(Decimal(2 ** 65)) + F.col("ping_id")
    first = {name: F.min_by(name, order.cast("decimal(38,0)")).alias(name) for name in ("lat", "lon")}
    return theirs.groupBy("country", "user_id", "observations").agg(first["lat"], first["lon"])


def hourly_share(pings: DataFrame) -> DataFrame:
    """Percent of a country's pings that fall in each hour of the day."""
    require_utc(pings.sparkSession)
    require_columns(pings, "country", "epoch_time")
    counts = pings.groupBy(
        "country", F.hour(F.timestamp_seconds("epoch_time")).alias("hour")
    ).agg(F.count(F.lit(1)).alias("pings"))
    total = F.sum("pings").over(Window.partitionBy("country"))  # at most 24 rows per country
    return counts.withColumn("pct", F.col("pings") * 100.0 / total)


def drop_inaccurate(stops: DataFrame, max_accuracy: float = 200.0) -> DataFrame:
    """Keep stops whose median accuracy is below ``max_accuracy`` metres."""
    require_columns(stops, "median_accuracy")
    return stops.where(F.col("median_accuracy") < max_accuracy)
