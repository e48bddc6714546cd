"""Sessions and stop detection."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from dwellpath.functions.ranking import rank_in_time
from dwellpath.functions.selection import exact_medians
from dwellpath.operators.pings import drop_inaccurate, validate_pings
from dwellpath.operators.stop_chains import FOUND, GUESSED, PLAN, WALKED, join_units, settle_groups, walk_stretches
from dwellpath.operators.stop_pass import PING, SEARCH_FIELDS, STOP, SUMMARY, search_periods
from dwellpath.params import StopParams
from dwellpath.schema import STOPS, require_columns
from dwellpath.session import cut_lineage, dealt_by, shuffled_if_long

# Executors need not have this package installed: the pass travels with the task.
cloudpickle.register_pickle_by_value(sys.modules["dwellpath"])

# Rows a task gets of a shuffle, unless one key has more: pings, and summaries of units, which are wide.
PINGS_PER_TASK = 500_000
UNITS_PER_TASK = 50_000

def sessionise(pings: DataFrame, max_gap: int = 3600) -> DataFrame:
    """Add ``session_id``, counting from 0 per user; a gap > ``max_gap`` starts a new one.

    A time bucket no wider than ``max_gap`` cannot contain such a gap, so sessions are
    decided between buckets: the pings are first reduced to one row per (user, bucket),
    combined before the shuffle, and only those rows are ordered along a user.  A user
    with a large part of all pings is thus never sorted in one task.  A ping without time
    has no session (NULL); pings without a user are sessions of one unknown user.
    """
    require_columns(pings, "user_id", "epoch_time")
    keyed = pings.withColumn("_bucket", F.floor(F.col("epoch_time") / max(max_gap, 1)))
    along = Window.partitionBy("user_id").orderBy("_bucket")
    sessions = (
        keyed.where(F.col("epoch_time").isNotNull()).groupBy("user_id", "_bucket")
        .agg(F.min("epoch_time").alias("_first"), F.max("epoch_time").alias("_last"))
        .withColumn("_new", F.coalesce(F.col("_first") - F.lag("_last").over(along) > max_gap, F.lit(False)))
        .select("user_id", "_bucket",
                F.sum(F.col("_new").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0))
                .alias("session_id"))
    )
    sessions = sessions.select(F.col("user_id").alias("_user"), F.col("_bucket").alias("_when"), "session_id")
    same = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_bucket") == F.col("_when"))
    return keyed.join(sessions, same, "left").select(*pings.columns, "session_id")


def detect_stops(pings: DataFrame, params: StopParams = StopParams(), on_invalid: str = "fail") -> DataFrame:
    """Every stop of every user, before the accuracy filter."""
    return _stops_with_ends(pings, params, on_invalid).select(*STOPS.fieldNames())


def label_pings(pings: DataFrame, params: StopParams = StopParams(), on_invalid: str = "fail") -> DataFrame:
    """For each ping the number of its stop, counted from 0 along the user, or -1 outside stops.

    A stop is a run of pings in the order of (``epoch_time``, ``ping_id``).  Stops are laid
    among the pings of each (user, period) they reach into, as one row that precedes its
    first ping there, and one pass in that order carries the last such row along; the ping
    is inside if it does not come after the stop's last one.  Time is linear in the pings
    of a period, however many stops it has.  Pings that repeat both time and id get one label.
    """
    period = params.period_seconds
    checked = pings if on_invalid == "keep" else validate_pings(pings, on_invalid)
    found = cut_lineage(_stops_with_ends(checked, params, "keep"))
    numbered = rank_in_time(found, "user_id", F.col("t_start"), [F.col("first_ping")], "stop", period)
    start = F.floor(F.col("t_start") / period)
    # a row of a stop sorts before the pings it holds; in later periods, before all pings
    laid = numbered.select(
        "user_id", F.explode(F.sequence(start, F.floor(F.col("t_end") / period))).alias("period"),
        start.alias("_start"), "t_start", "first_ping", F.lit(0).alias("side"),
        F.struct(F.col("stop"), F.col("t_end").alias("t"), F.col("last_ping").alias("p")).alias("held")).select(
        "user_id", "period", F.when(F.col("period") == F.col("_start"), F.col("t_start")).alias("epoch_time"),
        F.when(F.col("period") == F.col("_start"), F.col("first_ping")).alias("ping_id"), "side", "held")
    asked = checked.select(
        "user_id", F.floor(F.col("epoch_time") / period).alias("period"), "epoch_time", "ping_id", F.lit(1).alias("side"),
        F.lit(None).cast(laid.schema["held"].dataType).alias("held"))
    along = Window.partitionBy("user_id", "period").orderBy("epoch_time", F.asc_nulls_first("ping_id"), "side")
    last = F.last("held", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    here = F.struct(F.col("epoch_time").alias("t"), F.coalesce("ping_id", F.lit(0)).alias("p"))
    inside = here <= F.struct(F.col("last.t").alias("t"), F.col("last.p").alias("p"))
    rows = dealt_by(laid.unionByName(asked), asked.count(), PINGS_PER_TASK, "user_id", "period")
    return rows.withColumn("last", last).where("side = 1").select(
        "user_id", "ping_id", F.when(inside, F.col("last.stop")).otherwise(F.lit(-1)).cast("long").alias("stop"))


def _stops_with_ends(pings: DataFrame, params: StopParams, on_invalid: str) -> DataFrame:
    """Stops with their first and last ping; one route for every user.

    Pings are brought together by (user, period) and searched.  What touches an edge of a
    period is joined to its neighbours by one summary per edge; only pings that summaries
    leave undecided are walked again, in stretches that run side by side.  A stop that
    reaches over an edge is gathered by (user, stop), one that goes through whole periods
    is measured by counting in ranges, so no task holds more of a stop than two periods
    or one such stretch.
    """
    require_columns(pings, "user_id", "ping_id", "epoch_time", "lat", "lon", "accuracy")
    if on_invalid != "keep":
        pings = validate_pings(pings, on_invalid)
    step = params.coordinate_step
    lat, lon = ((F.round(F.col(c) / step) * step).alias(c) if step else F.col(c) for c in ("lat", "lon"))
    period = F.floor(F.col("epoch_time") / params.period_seconds)
    keyed = pings.select("user_id", "ping_id", "epoch_time", lat, lon, "accuracy", period.alias("period"))
    by_period = ["user_id", "period"]
    ordered = dealt_by(keyed, keyed.count(), PINGS_PER_TASK, *by_period).sortWithinPartitions(*by_period, "epoch_time", "ping_id")
    searched = cut_lineage(ordered.mapInArrow(lambda batches: search_periods(batches, params), from_arrow_schema(SEARCH_FIELDS)))
    touching = searched.where(F.col("kind") == PING).select(
        "user_id", "unit", "place", "opened", F.col("t_start").alias("epoch_time"), F.col("first_ping").alias("ping_id"),
        "lat", "lon", F.col("median_accuracy").alias("accuracy"))
    size = {row["kind"]: row["count"] for row in searched.groupBy("kind").count().collect()}
    plan, walked, through = _joined_units(searched, touching, size, params)
    owned = _with_groups(touching, plan, walked)
    group = ["user_id", "group_unit", "group_place"]
    gathered = dealt_by(owned.where("not through"), size.get(PING, 0), PINGS_PER_TASK, *group).sortWithinPartitions(*group, "unit", "place")
    stops = searched.where(F.col("kind") == STOP).select(*_ENDS.fieldNames()).unionByName(
        gathered.mapInArrow(lambda batches: settle_groups(batches, params), _ENDS))
    return stops.unionByName(_measured(owned.where("through"), group, params)) if through else stops


_ENDS = T.StructType([*STOPS.fields, T.StructField("first_ping", T.LongType()), T.StructField("last_ping", T.LongType())])


def _joined_units(searched: DataFrame, touching: DataFrame, size: dict[int, int], params: StopParams) -> tuple[DataFrame, DataFrame | None, bool]:
    """The plan that joins all units, what walks have found on the way, and whether a stop goes through whole units.

    Each round walks the stretches that are still open, over four times as many units as before,
    so the number of rounds grows with the logarithm of the longest run of units in which
    walk and guess never agree.
    """
    nothing = F.lit(None).cast("long")
    units = searched.where(F.col("kind") == SUMMARY).select(
        "user_id", "unit", F.lit(GUESSED).alias("kind"), "t_start", "t_end", "marks", "counts", nothing.alias("head_unit"),
        nothing.alias("head_place"), nothing.alias("last_unit"))
    walked, reach = None, 1
    while True:
        # the loop's present value is bound to the function, which runs later
        plan = cut_lineage(dealt_by(units, size.get(SUMMARY, 0), UNITS_PER_TASK, "user_id").sortWithinPartitions("user_id", "unit", "kind").mapInArrow(
            lambda batches, reach=reach: join_units(batches, params, reach), from_arrow_schema(PLAN)))
        rows, more, through = plan.agg(F.count(F.lit(1)), F.count_if("asked"), F.bool_or("lead_through")).first()
        asked = shuffled_if_long(plan.where("asked"), more)
        if not more:
            return shuffled_if_long(plan, rows), walked, bool(through)
        stretch = ["user_id", "walk_unit", "walk_head_unit", "walk_head_place"]
        pings = touching.join(_named(asked, "user_id", "unit"), _same("user_id", "unit")).where("place >= from_place").select(
            *touching.columns, *stretch[1:])
        found = cut_lineage(dealt_by(pings, size.get(PING, 0), PINGS_PER_TASK, *stretch).sortWithinPartitions(*stretch, "unit", "place").mapInArrow(
            lambda batches: walk_stretches(batches, params), from_arrow_schema(WALKED)))
        walked = found if walked is None else walked.unionByName(found)
        units = units.unionByName(found.where("kind = 1").select(
            "user_id", F.col("walk_unit").alias("unit"), F.lit(FOUND).alias("kind"), nothing.alias("t_start"),
            nothing.alias("t_end"), "marks", "counts", F.col("walk_head_unit").alias("head_unit"),
            F.col("walk_head_place").alias("head_place"), "last_unit"))
        reach *= 4


def _with_groups(touching: DataFrame, plan: DataFrame, walked: DataFrame | None) -> DataFrame:
    """Pings of units with the unit and place that open their group, and whether it goes ``through`` whole units."""
    columns = ["user_id", "unit", "place", "epoch_time", "ping_id", "lat", "lon", "accuracy"]
    leads = ((F.col("opened") == 0) | F.col("lead_whole")) & F.col("lead_unit").isNotNull()
    of_group = (F.col("group_unit") == F.col("through_unit")) & (F.col("group_place") == F.col("through_place"))
    plain = touching.join(
        _named(plan.where("walk_unit is null"), "user_id", "unit"), _same("user_id", "unit")).select(
        *columns, F.when(leads, F.col("lead_unit")).otherwise(F.col("unit")).alias("group_unit"),
        F.when(leads, F.col("lead_place")).otherwise(F.col("opened")).alias("group_place"),
        "lead_through", "through_unit", "through_place", leads.alias("leads")).select(
        *columns, "group_unit", "group_place",
        F.coalesce(F.when(F.col("leads"), F.col("lead_through")).otherwise(of_group), F.lit(False)).alias("through"))
    if walked is None:
        return plain
    walk = ["user_id", "unit", "walk_unit", "walk_head_unit", "walk_head_place"]
    of_head = (F.col("group_unit") == F.col("walk_head_unit")) & (F.col("group_place") == F.col("walk_head_place"))
    return plain.unionByName(
        walked.where("kind = 0").join(_named(plan.where("walk_unit is not null").select(
            *walk, "head_through", "through_unit", "through_place"), *walk), _same(*walk)).select(
            *columns, "group_unit", "group_place",
            F.coalesce((of_head & F.col("head_through")) | of_group, F.lit(False)).alias("through")))


def _measured(pings: DataFrame, group: list[str], params: StopParams) -> DataFrame:
    """Stops from groups of any size, none of which is gathered."""
    pings = cut_lineage(pings)  # read for the ends, and to count values
    seen = F.struct("unit", "place", F.col("epoch_time").alias("t"), F.col("ping_id").alias("p"))
    ends = cut_lineage(pings.groupBy(*group).agg(
        F.min(seen).alias("first"), F.max(seen).alias("last"), F.count(F.lit(1)).alias("total_pings_stop")))
    if params.min_stay is not None:
        ends = ends.where(F.col("last.t") - F.col("first.t") >= params.min_stay)
    ends = ends.where(F.col("total_pings_stop") >= params.min_size)
    last = (F.col("unit") == F.col("last.unit")) & (F.col("place") == F.col("last.place"))
    values = pings.join(_named(ends.select(*group, "last"), *group), _same(*group)).select(
        *group, F.explode(F.create_map(
            F.lit("lat"), F.col("lat"), F.lit("lon"), F.col("lon"),
            F.when(last & F.lit(not params.accuracy_includes_last), "last").otherwise("accuracy"), F.col("accuracy"))).alias(
            "axis", "value")).where("axis <> 'last'")
    medians = exact_medians(values, [*group, "axis"]).groupBy(*group).agg(*[
        F.max(F.when(F.col("axis") == axis, F.col("median"))).alias(axis) for axis in ("lat", "lon", "accuracy")])
    return ends.join(_named(medians, *group), _same(*group)).select(
        "user_id", F.col("first.t").alias("t_start"), F.col("last.t").alias("t_end"), "lat", "lon",
        F.col("accuracy").alias("median_accuracy"), "total_pings_stop", F.col("first.p").alias("first_ping"),
        F.col("last.p").alias("last_ping"))


def _named(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumnsRenamed({key: f"_{key}" for key in keys})


def _same(*keys: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])


def find_stop_locations(pings: DataFrame, params: StopParams = StopParams(), max_accuracy: float = 200.0,
                        cluster_radius_m: float | None = None, on_invalid: str = "fail") -> DataFrame:
    """Stops of sufficient accuracy with their cluster, per user."""
    from dwellpath.operators.clusters import CLUSTER_RADIUS_M, cluster_stops

    stops = drop_inaccurate(detect_stops(pings, params, on_invalid), max_accuracy)
    return cluster_stops(stops, CLUSTER_RADIUS_M if cluster_radius_m is None else cluster_radius_m)
