"""Population-weighted indicators by wealth, and their change over time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.functions.series import centred_frame, guarded, trailing_frame
from dwellpath.functions.times import monday_weekday
from dwellpath.operators.admin import with_wealth_label
from dwellpath.schema import require_columns

HOME_KEYS = ("wealth_label_home",)
HOME_WORK_KEYS = ("wealth_label_home", "wealth_label_work")


def weight_by_home(metrics: DataFrame, admins: DataFrame, bins: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """G1: attach the home unit; ``weight`` is its population per observed user.

    ``admins`` has ``geom_id``, ``pop`` and ``pct_wealth``.
    """
    return _weighted(metrics.join(_side(admins, bins, labels, "home", with_pop=True), "geom_id_home"))


def weight_by_home_and_work(metrics: DataFrame, admins: DataFrame, bins: Sequence[float],
                            labels: Sequence[str]) -> DataFrame:
    """As G1, for users with a known work unit, which is attached too."""
    return _weighted(
        metrics.join(_side(admins, bins, labels, "home", with_pop=True), "geom_id_home")
        .join(_side(admins, bins, labels, "work", with_pop=False), "geom_id_work"))


def indicator(weighted: DataFrame, column: str, keys: Sequence[str] = HOME_KEYS) -> DataFrame:
    """Weighted mean, unweighted standard error and counts of one column per date and keys."""
    return indicators(weighted, {column: column}, keys).drop("measure")


def indicators(weighted: DataFrame, measures: Mapping[str, str], keys: Sequence[str] = HOME_KEYS) -> DataFrame:
    """G3/G4 for several columns in one aggregation; ``measures`` maps measure names to columns.

    Missing values count as 0.  The sums are combined before the shuffle, so only one row
    per task and group travels.  Distinct users are counted beside them on narrow rows;
    in one aggregation every row would travel with all its sums.  Each group adds one row
    per measure at the end.
    """
    require_columns(weighted, "date", "user_id", "weight", *keys, *measures.values())
    groups = ["date", *keys]
    values = {name: F.coalesce(F.col(column).cast("double"), F.lit(0.0)) for name, column in measures.items()}
    sums = [
        aggregate
        for i, value in enumerate(values.values())
        for aggregate in (F.sum(value * F.col("weight")).alias(f"s{i}"), F.stddev_samp(value).alias(f"d{i}"))
    ]
    summed = weighted.groupBy(*groups).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), *sums)
    users = weighted.select(*groups, "user_id").distinct().groupBy(*groups).agg(F.count("user_id").alias("n_unique"))
    users = users.select(*[F.col(name).alias(f"_{name}") for name in groups], "n_unique")
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in groups])
    rows = F.array(*[
        F.struct(F.lit(name).alias("measure"), F.try_divide(F.col(f"s{i}"), F.col("w")).alias("mean"),
                 (F.col(f"d{i}") / F.sqrt(F.col("n").cast("double"))).alias("sem"))
        for i, name in enumerate(values)
    ])
    return summed.join(users, same).select(*groups, "n", "n_unique", F.explode(rows).alias("r")).select(
        "r.measure", *groups, "r.mean", "r.sem", "n", "n_unique")


def indicator_results(weighted_home: DataFrame, weighted_home_work: DataFrame, home_measures: Mapping[str, str],
                      home_work_measures: Mapping[str, str], state: str) -> DataFrame:
    """All indicators of one state in one long table; the work label is NULL where it is no key."""
    by_home = indicators(weighted_home, home_measures).withColumn("wealth_label_work", F.lit(None).cast("string"))
    by_both = indicators(weighted_home_work, home_work_measures, HOME_WORK_KEYS)
    return by_home.unionByName(by_both).withColumn("state", F.lit(state))


def change_from_baseline(series: DataFrame, start: str, end: str, groups: Sequence[str] = ()) -> DataFrame:
    """``mean`` and ``sem`` relative to the mean of the same weekday in the baseline period.

    Groups that are NULL have a baseline of their own; a zero or missing baseline gives NULL.
    """
    based = _with_baseline(series, "mean", start, end, groups)
    size = F.abs(F.col("_base"))
    return based.withColumns({
        "mean": F.try_divide(F.col("mean") - F.col("_base"), size),
        "sem": F.abs(F.try_divide(F.col("sem"), F.col("_base"))),
    }).drop("_base")


def difference_from_baseline(series: DataFrame, column: str, start: str, end: str,
                             groups: Sequence[str] = ()) -> DataFrame:
    """``column`` minus its weekday baseline, as ``mean``."""
    renamed = series.withColumnRenamed(column, "mean")
    based = _with_baseline(renamed, "mean", start, end, groups)
    return based.withColumn("mean", F.col("mean") - F.col("_base")).drop("_base")


def metric_by_label(results: DataFrame, metric: str, state: str, labels: Sequence[str], start: str, end: str,
                    groups: Sequence[str] = ()) -> DataFrame:
    """Baseline change of one metric, one row per date, columns ``<label>`` and ``<label>_StdErr``.

    Metrics with ``_hw`` in their name show users living in units of the first label, by
    the label of their work unit.
    """
    rows = results.where((F.col("state") == state) & (F.col("measure") == metric))
    label = "wealth_label_home"
    if "_hw" in metric:
        rows = rows.where(F.col("wealth_label_home") == labels[0])
        label = "wealth_label_work"
    changed = change_from_baseline(rows, start, end, groups)

    def only(name: str, column: str) -> Column:
        return F.max(F.when(F.col(label) == name, F.col(column)))

    return (
        changed.groupBy("date").agg(*[only(name, "mean").alias(name) for name in labels],
                                    *[only(name, "sem").alias(f"{name}_StdErr") for name in labels])
        .withColumns({"metric": F.lit(metric), "state": F.lit(state)})
    )


def smoothed_range(wide: DataFrame, labels: Sequence[str], start: str, end: str, rows: int) -> DataFrame:
    """Lowest and highest trailing mean over full windows of ``rows`` rows between two dates."""
    frame = trailing_frame(_along("date"), rows)
    inside = wide.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    smooth = inside.select("metric", "state", *[guarded(c, F.avg(c), frame, rows).alias(c) for c in labels])
    lowest = F.least(*[F.col(c) for c in labels]) if len(labels) > 1 else F.col(labels[0])
    highest = F.greatest(*[F.col(c) for c in labels]) if len(labels) > 1 else F.col(labels[0])
    return smooth.groupBy("metric", "state").agg(F.min(lowest).alias("lowest"), F.max(highest).alias("highest"))


def smooth_metric(wide: DataFrame, labels: Sequence[str], start: str, end: str, rows: int,
                  min_rows: int | None = None, crop_first: bool = False) -> DataFrame:
    """Centred rolling mean of every column, with a band of two standard errors.

    By default only full windows count and the dates are cropped afterwards.  With
    ``crop_first`` and ``min_rows=1`` the series is cropped before, and partial windows
    at its ends are used.
    """
    needed = rows if min_rows is None else min_rows
    frame = centred_frame(_along("date"), rows)
    crop = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    columns = [*labels, *[f"{c}_StdErr" for c in labels]]
    source = wide.where(crop) if crop_first else wide
    smooth = source.select("metric", "state", "date", *[guarded(c, F.avg(c), frame, needed).alias(c) for c in columns])
    bands = {}
    for c in labels:
        bands[f"{c}_lower"] = F.col(c) - 2 * F.col(f"{c}_StdErr")
        bands[f"{c}_upper"] = F.col(c) + 2 * F.col(f"{c}_StdErr")
    return smooth.where(crop).withColumns(bands)


def _side(admins: DataFrame, bins: Sequence[float], labels: Sequence[str], side: str, with_pop: bool) -> DataFrame:
    names = ["geom_id", *(["pop"] if with_pop else []), "pct_wealth", "wealth_label"]
    return with_wealth_label(admins, bins, labels).select(*[F.col(n).alias(f"{n}_{side}") for n in names])


def _weighted(joined: DataFrame) -> DataFrame:
    users = joined.select("geom_id_home", "user_id").distinct().groupBy("geom_id_home").agg(
        F.count(F.lit(1)).alias("n_users"))
    return joined.join(users, "geom_id_home").withColumn("weight", F.col("pop_home") / F.col("n_users"))


def _with_baseline(series: DataFrame, column: str, start: str, end: str, groups: Sequence[str]) -> DataFrame:
    require_columns(series, "date", column, *groups)
    day = F.col("date")
    dated = series.withColumn("_weekday", monday_weekday(day))
    base = (
        dated.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("_weekday", *groups).agg(F.avg(column).alias("_base"))
        .select(F.col("_weekday").alias("_b0"), *[F.col(g).alias(f"_b{i}") for i, g in enumerate(groups, 1)], "_base")
    )
    same = F.col("_weekday") == F.col("_b0")
    for i, group in enumerate(groups, 1):
        same = same & F.col(group).eqNullSafe(F.col(f"_b{i}"))
    return dated.join(base, same, "left").select(*series.columns, "_base")


def _along(order: str):
    """A series has one row per date, so its window stays as small as the calendar."""
    return Window.partitionBy("metric", "state").orderBy(order)
