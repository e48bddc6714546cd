"""Home and work labels of day pieces.

Evidence is first reduced to one row per (user, cluster, day); rolling windows, daily
choices and gap filling run on those rows.  The pieces themselves are shuffled once, for
the join that hands the labels back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.functions.times import day_number
from dwellpath.params import LabelParams
from dwellpath.schema import LABELLED_PIECES, require_columns

_KEY = ["user_id", "cluster_label", "date_trunc"]


def initialise_labels(pieces: DataFrame) -> DataFrame:
    """Every piece starts as 'O' without home or work label."""
    return pieces.withColumns({
        "location_type": F.lit("O"),
        "home_label": F.lit(-1).cast("long"),
        "work_label": F.lit(-1).cast("long"),
    })


def night_pieces(pieces: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """Pieces that start late or end early.  A piece ending at 24:00 ends at hour 0."""
    return pieces.where((F.col("t_start_hour") >= p.end_hour_day) | (F.col("t_end_hour") <= p.start_hour_day))


def work_hour_pieces(pieces: DataFrame, homes: DataFrame | None = None, p: LabelParams = LabelParams()) -> DataFrame:
    """Weekday pieces inside working hours, at clusters not in ``homes`` (``user_id``, ``cluster_label``)."""
    inside = (F.col("t_start_hour") >= p.start_hour_day + 4) & (F.col("t_end_hour") <= p.end_hour_day - 6)
    return _without(pieces.where(inside & ~F.col("weekday").isin(1, 7)), homes)


def home_evidence(pieces: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """Days on which a cluster qualifies as home, with the rolling sums behind it."""
    require_columns(pieces, *_KEY, "duration", "total_pings_stop", "t_start_hour", "t_end_hour")
    trailing = _trailing_days(p.home_window_days)
    days = F.count(F.lit(1)).over(trailing)
    return (
        _per_day(night_pieces(pieces, p))
        .select("*", days.alias("days_count"),
                F.when(days >= p.home_min_days, F.sum("duration").over(trailing)).alias("duration_cum"),
                F.when(days >= p.home_min_days, F.sum("total_pings_stop").over(trailing)).alias("total_pings_cum"))
        .where((F.col("total_pings_cum") > p.min_pings_home) & F.col("duration_cum").isNotNull())
        .drop("_day")
    )


def work_evidence(pieces: DataFrame, homes: DataFrame | None = None, p: LabelParams = LabelParams()) -> DataFrame:
    """Days on which a cluster qualifies as work, with the rolling mean behind it.

    Clusters in ``homes`` are left out.  Windows never span clusters, so they can be
    dropped at the end, where few rows remain.
    """
    require_columns(pieces, *_KEY, "duration", "total_pings_stop", "t_start_hour", "t_end_hour", "weekday")
    trailing = _trailing_days(p.work_window_days)
    enough = F.count(F.lit(1)).over(trailing) >= p.work_min_days
    return _without(
        _per_day(work_hour_pieces(pieces, p=p))
        .select("*", F.when(enough, F.avg("duration").over(trailing)).alias("duration_average"))
        .where(F.col("duration_average") >= p.work_min_seconds)
        .drop("_day"),
        homes,
    )


def daily_pick(evidence: DataFrame) -> DataFrame:
    """One cluster per user and day, the lowest that qualifies."""
    return evidence.groupBy("user_id", "date_trunc").agg(F.min("cluster_label").alias("cluster_label"))


def fill_gaps(picks: DataFrame) -> DataFrame:
    """A pick for every day from a user's first to last; gaps take the nearest.

    Halfway between two picks the earlier one wins.  ``observed`` tells picks from
    filled days.
    """
    along = Window.partitionBy("user_id").orderBy("date_trunc")
    gap = F.col("_gap")
    return (
        picks.withColumn("_gap", F.datediff(F.lead("date_trunc").over(along), F.col("date_trunc")))
        .withColumn("_next", F.lead("cluster_label").over(along))
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.coalesce(gap - 1, F.lit(0)))))
        .select(
            "user_id",
            F.date_add("date_trunc", F.col("_step")).alias("date_trunc"),
            F.when((F.col("_step") == 0) | (F.col("_step") * 2 <= gap), F.col("cluster_label"))
            .otherwise(F.col("_next")).alias("cluster_label"),
            (F.col("_step") == 0).alias("observed"),
        )
    )


def label_home(pieces: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """Pieces with ``location_type`` 'H' or 'O' and ``home_label``."""
    return _attach(initialise_labels(pieces), _marks(_tagged(daily_pick(home_evidence(pieces, p)), "H")))


def label_work(labelled: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """Add 'W' and ``work_label`` to pieces that already carry home labels."""
    require_columns(labelled, "location_type", "home_label", "work_label")
    evidence = work_evidence(labelled, labelled.where(F.col("location_type") == "H"), p)
    return _attach(labelled, _marks(_tagged(evidence, "W")))


def label_home_and_work(pieces: DataFrame, p: LabelParams = LabelParams()) -> DataFrame:
    """Both labels in one plan that computes each kind of evidence once.

    Home picks and work evidence are brought together by user, a few rows per day; there,
    work evidence at a home cluster is dropped and days are filled.  A single join hands
    the marks back.
    """
    tagged = _tagged(daily_pick(home_evidence(pieces, p)), "H").unionByName(_tagged(work_evidence(pieces, p=p), "W"))
    is_home = F.max(F.col("_kind") == "H").over(Window.partitionBy("user_id", "cluster_label"))
    apart = tagged.repartition("user_id").withColumn("_home", is_home).where((F.col("_kind") == "H") | ~F.col("_home"))
    return _attach(initialise_labels(pieces), _marks(apart.drop("_home")))


def select_label_columns(labelled: DataFrame) -> DataFrame:
    """Exactly the columns of labelled pieces."""
    names = LABELLED_PIECES.fieldNames()
    require_columns(labelled, *names)
    return labelled.select(*names)


def day_share(pieces: DataFrame) -> DataFrame:
    """Share of a user's recorded day spent at each cluster."""
    total = F.sum("duration").over(Window.partitionBy("user_id", "date_trunc"))
    return (
        pieces.groupBy(*_KEY).agg(F.sum("duration").alias("duration"))
        .withColumn("day_share", F.try_divide(F.col("duration").cast("double"), total.cast("double")))
    )


def active_day_share(pieces: DataFrame, window_days: int) -> DataFrame:
    """Days at a cluster over active days, from ``window_days`` before a day up to it.

    Days are made distinct before the windows, so plain counts suffice.
    """

    def since(*keys: str):
        return Window.partitionBy(*keys).orderBy(day_number(F.col("date_trunc"))).rangeBetween(-window_days, 0)

    visits = pieces.select(*_KEY).distinct()
    active = visits.select("user_id", "date_trunc").distinct().withColumn(
        "active_days", F.count(F.lit(1)).over(since("user_id")))
    return (
        visits.withColumn("cluster_days", F.count(F.lit(1)).over(since("user_id", "cluster_label")))
        .join(active, ["user_id", "date_trunc"])
        .withColumn("active_day_share", F.col("cluster_days") / F.col("active_days"))
    )


def start_hour_histogram(labelled: DataFrame) -> DataFrame:
    """Pieces per type, weekday and start hour; hour 0 is left out as it comes from the cut at midnight."""
    require_columns(labelled, "location_type", "weekday", "t_start_hour")
    return (
        labelled.where(F.col("t_start_hour") != 0)
        .groupBy("location_type", "weekday", "t_start_hour").agg(F.count(F.lit(1)).alias("pieces"))
    )


def _without(rows: DataFrame, homes: DataFrame | None) -> DataFrame:
    if homes is None:
        return rows
    return rows.join(homes.select("user_id", "cluster_label").distinct(), ["user_id", "cluster_label"], "left_anti")


def _per_day(pieces: DataFrame) -> DataFrame:
    """Sums per (user, cluster, day), combined before the shuffle."""
    return (
        pieces.groupBy(*_KEY).agg(F.sum("duration").alias("duration"), F.sum("total_pings_stop").alias("total_pings_stop"))
        .withColumn("_day", day_number(F.col("date_trunc")))
    )


def _trailing_days(days: int):
    return Window.partitionBy("user_id", "cluster_label").orderBy("_day").rangeBetween(-(days - 1), 0)


def _tagged(days: DataFrame, kind: str) -> DataFrame:
    return days.select(*_KEY, F.lit(kind).alias("_kind"))


def _marks(tagged: DataFrame) -> DataFrame:
    """One row per (user, cluster, day) to mark, from the qualifying clusters of each kind.

    The lowest cluster of a day, or the nearest one on a day without any, sets the type.
    Every qualifying cluster sets the label.  A user-day has few clusters: the stops of
    a user do not overlap.
    """
    along = Window.partitionBy("user_id", "_kind").orderBy("date_trunc")
    gap, step = F.col("_gap"), F.col("_step")
    days = (
        tagged.repartition("user_id").groupBy("user_id", "_kind", "date_trunc")
        .agg(F.min("cluster_label").alias("_pick"), F.collect_set("cluster_label").alias("_all"))
        .withColumn("_gap", F.datediff(F.lead("date_trunc").over(along), F.col("date_trunc")))
        .withColumn("_next", F.lead("_pick").over(along))
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.coalesce(gap - 1, F.lit(0)))))
    )
    nearest = F.when(step * 2 <= gap, F.col("_pick")).otherwise(F.col("_next"))
    return (
        days.withColumn("cluster_label", F.explode(F.when(step == 0, F.col("_all")).otherwise(F.array(nearest))))
        .select(
            "user_id", "cluster_label", F.date_add("date_trunc", step).alias("date_trunc"),
            F.when((step > 0) | (F.col("cluster_label") == F.col("_pick")), F.col("_kind")).alias("_type"),
            F.when((step == 0) & (F.col("_kind") == "H"), F.col("cluster_label")).alias("_home_label"),
            F.when((step == 0) & (F.col("_kind") == "W"), F.col("cluster_label")).alias("_work_label"),
        )
    )


def _attach(pieces: DataFrame, marks: DataFrame) -> DataFrame:
    return (
        pieces.join(marks, _KEY, "left")
        .withColumn("location_type", F.coalesce("_type", "location_type"))
        .withColumn("home_label", F.coalesce("_home_label", "home_label"))
        .withColumn("work_label", F.coalesce("_work_label", "work_label"))
        .select(*pieces.columns)
    )
