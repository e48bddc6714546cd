"""Daily time budgets, active users and their admin units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.params import ActivityParams
from dwellpath.schema import LOCATION_TYPES, require_columns
from dwellpath.session import require_utc


def time_budgets(labelled: DataFrame, start_hour_day: int = 5, end_hour_day: int = 23) -> DataFrame:
    """Seconds and whole-day shares per type, for the day and the night part of a user's day.

    Both parts are summed in one aggregation per (user, day), which also yields the
    whole-day total; they become rows afterwards without another shuffle.
    """
    require_utc(labelled.sparkSession)
    require_columns(labelled, "user_id", "date", "date_trunc", "location_type", "duration")
    hour = F.hour("date")
    part = F.when((hour >= start_hour_day) & (hour < end_hour_day), "day").when(hour.isNotNull(), "night")
    sums = [
        F.sum(F.when((F.col("part") == name) & (F.col("location_type") == kind), F.col("duration"))).alias(f"{name}_{kind}")
        for name in ("day", "night") for kind in LOCATION_TYPES
    ]
    seen = [F.count_if(F.col("part") == name).alias(f"{name}_n") for name in ("day", "night")]
    per_day = (
        labelled.select("user_id", "date_trunc", "location_type", "duration", part.alias("part"))
        .groupBy("user_id", "date_trunc").agg(F.sum("duration").alias("total"), *sums, *seen)
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("day_night"), F.col(f"{name}_n").alias("n"),
                 *[F.col(f"{name}_{kind}").alias(kind) for kind in LOCATION_TYPES])
        for name in ("day", "night")
    ])
    return (
        per_day.select("user_id", "date_trunc", F.col("total").cast("double").alias("total"),
                       F.explode(F.filter(rows, lambda row: row["n"] > 0)).alias("r"))
        .select("user_id", "date_trunc", "r.day_night",
                *[F.try_divide(F.col(f"r.{kind}").cast("double"), F.col("total")).alias(kind) for kind in LOCATION_TYPES],
                *[F.col(f"r.{kind}").alias(f"absolute_{kind}") for kind in LOCATION_TYPES])
    )


def active_users(budgets: DataFrame, p: ActivityParams = ActivityParams()) -> DataFrame:
    """Users with enough active days before the split and overall, measured against the maximum.

    The maxima enter as scalar subqueries of the same plan.
    """
    require_columns(budgets, "user_id", "date_trunc")
    return _active(budgets.select("user_id", "date_trunc").distinct(), p)


def active_users_by_country(budgets: DataFrame, activity: Mapping[str, ActivityParams]) -> DataFrame:
    """E2 for all countries at once: active users per ``country``, each measured by its country's parameters and maxima.

    The parameters are one row per country, joined to the days; countries without any are left out.
    """
    require_columns(budgets, "country", "user_id", "date_trunc")
    rows = [(country, float(p.level), p.start, p.split, p.end) for country, p in activity.items()]
    rules = budgets.sparkSession.createDataFrame(
        rows, "country string, level double, start string, split string, end string").select(
        "country", "level", *[F.col(name).cast("date").alias(name) for name in ("start", "split", "end")])
    day = F.col("date_trunc")
    per_user = (
        budgets.select("country", "user_id", "date_trunc").distinct().join(rules, "country")
        .where((day < F.col("end")) & (F.col("start").isNull() | (day >= F.col("start"))))
        .groupBy("country", "user_id").agg(
            F.count_if(day < F.col("split")).alias("pre"), F.count_if(day >= F.col("split")).alias("post"))
        .withColumn("tot", F.col("pre") + F.col("post")))
    top = per_user.groupBy("country").agg(F.max("pre").alias("top_pre"), F.max("tot").alias("top_tot"))
    return per_user.join(top, "country").join(rules.select("country", "level"), "country").where(
        (F.col("pre") >= F.col("level") * F.col("top_pre")) & (F.col("tot") >= F.col("level") * F.col("top_tot"))).select(
        "country", "user_id", "pre", "post", "tot")


def daily_metrics(budgets: DataFrame, p: ActivityParams = ActivityParams()) -> DataFrame:
    """H, W, O shares per active user and day, with C (went to work) and R (stayed home).

    Budgets have at most two rows per user and day, so they are brought together by user
    once; the sums, the activity count and the semi join all work on that partitioning.
    """
    require_columns(budgets, "user_id", "date_trunc", *LOCATION_TYPES)
    daily = budgets.select("user_id", "date_trunc", *LOCATION_TYPES).repartition("user_id").groupBy(
        "user_id", "date_trunc").agg(*[F.sum(kind).alias(kind) for kind in LOCATION_TYPES])
    away = F.col("W").isNotNull() | F.col("O").isNotNull()
    return (
        daily.join(_active(daily, p).select("user_id"), "user_id", "left_semi")
        .select("user_id", F.col("date_trunc").alias("date"), "H",
                F.when(away, 0).otherwise(1).alias("R"), "W",
                F.when(F.col("W").isNull(), 0).otherwise(1).alias("C"), "O")
    )


def _active(days: DataFrame, p: ActivityParams) -> DataFrame:
    """Activity from one row per (user, day)."""
    day = F.col("date_trunc")
    counted = days.where(day < F.lit(p.end).cast("date"))
    if p.start is not None:
        counted = counted.where(day >= F.lit(p.start).cast("date"))
    before = day < F.lit(p.split).cast("date")
    per_user = (
        counted.groupBy("user_id")
        .agg(F.count_if(before).alias("pre"), F.count_if(~before).alias("post"))
        .withColumn("tot", F.col("pre") + F.col("post"))
    )
    top = per_user.agg(F.max("pre").alias("pre"), F.max("tot").alias("tot"))
    return per_user.where(
        (F.col("pre") >= p.level * top.select("pre").scalar()) & (F.col("tot") >= p.level * top.select("tot").scalar())
    )


def modal_admin_unit(labelled: DataFrame, location_type: str, name: str, until: str | None = None,
                     keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Per user (or ``keys``) the admin unit with most distinct days of the given type; ties to the lowest id."""
    require_columns(labelled, "user_id", "geom_id", "location_type", "date_trunc")
    rows = labelled.where(F.col("location_type") == location_type)
    if until is not None:
        rows = rows.where(F.col("date_trunc") <= F.lit(until).cast("date"))
    visits = rows.select(*keys, "geom_id", "date_trunc").distinct()
    days = visits.repartition(*keys).groupBy(*keys, "geom_id").agg(F.count(F.lit(1)).alias("n_days"))
    best = F.min(F.struct((-F.col("n_days")).alias("rank"), "geom_id"))
    return days.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.geom_id").alias(name))


def metrics_with_admins(labelled: DataFrame, budgets: DataFrame, p: ActivityParams = ActivityParams()) -> DataFrame:
    """E5: daily metrics with the home unit (up to the split date) and the work unit of the user."""
    homes = modal_admin_unit(labelled, "H", "geom_id_home", until=p.split)
    works = modal_admin_unit(labelled, "W", "geom_id_work")
    return daily_metrics(budgets, p).join(homes, "user_id", "left").join(works, "user_id", "left")
