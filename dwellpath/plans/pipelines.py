"""Whole chains, from pings to labelled pieces, indicators and migration series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.operators.admin import (
    add_urban_rural,
    main_metro_units,
    units_of_country,
    urban_rural,
    wealth_percentile,
)
from dwellpath.operators.budgets import (
    active_users,
    active_users_by_country,
    metrics_with_admins,
    modal_admin_unit,
    time_budgets,
)
from dwellpath.operators.days import day_pieces
from dwellpath.operators.indicators import indicator_results, weight_by_home, weight_by_home_and_work
from dwellpath.operators.labels import label_home_and_work
from dwellpath.operators.migration import home_moves, home_units, metro_residents, mover_counts, user_info
from dwellpath.operators.pings import localise
from dwellpath.operators.stops import find_stop_locations
from dwellpath.params import ActivityParams, LabelParams, StopParams
from dwellpath.schema import require_columns
from dwellpath.session import cut_for_joins, cut_lineage

# Measure names and the columns of daily metrics they average.
HOME_MEASURES = {"t_home": "H", "t_work": "W", "t_other": "O", "rec": "R", "comms": "C"}
HOME_WORK_MEASURES = {"comms_hw": "C"}


def labelled_pieces_of(pings: DataFrame, zones: DataFrame | None = None, units_of=None,
                       stop_params: StopParams = StopParams(), label_params: LabelParams = LabelParams(),
                       max_accuracy: float = 200.0, on_invalid: str = "fail") -> DataFrame:
    """Entry 1: pings to labelled day pieces.

    ``zones`` shifts the pings to local time first.  ``units_of`` adds ``geom_id`` to a
    DataFrame of stops; without it the column is NULL.  The stops feed three branches of
    the labelling, so they are written once.
    """
    local = pings if zones is None else localise(pings, zones)
    stops = cut_lineage(find_stop_locations(local, stop_params, max_accuracy, on_invalid=on_invalid))
    stops = stops.withColumn("geom_id", F.lit(None).cast("string")) if units_of is None else units_of(stops)
    return label_home_and_work(day_pieces(stops), label_params)


def indicators_of(labelled: DataFrame, admins: DataFrame, bins: Sequence[float], labels: Sequence[str], state: str,
                  activity: ActivityParams = ActivityParams(), label_params: LabelParams = LabelParams(),
                  home_measures: Mapping[str, str] = HOME_MEASURES,
                  home_work_measures: Mapping[str, str] = HOME_WORK_MEASURES) -> DataFrame:
    """Entry 2: labelled pieces to the long table of weighted indicators.

    Budgets and metrics feed several branches, and the result is a small table that later
    steps read more than once, so each is written.  ``state`` is the country whose units
    are used; users without a unit in it do not count.
    """
    admins = units_of_country(admins, state)
    budgets = cut_lineage(time_budgets(labelled, label_params.start_hour_day, label_params.end_hour_day))
    metrics = cut_for_joins(metrics_with_admins(labelled, budgets, activity))
    wealth = wealth_percentile(admins)
    return cut_lineage(indicator_results(
        weight_by_home(metrics, wealth, bins, labels), weight_by_home_and_work(metrics, wealth, bins, labels),
        home_measures, home_work_measures, state))


def city_migration(labelled: DataFrame, budgets: DataFrame, admins: DataFrame, bins: Sequence[float],
                   labels: Sequence[str], country: str, activity: ActivityParams = ActivityParams(),
                   seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """H6: daily mover counts of the main metro area's residents, and who they are.

    Both are small tables that the series built on them read more than once, so they are
    written.  Units of other countries in ``admins`` play no part.
    """
    admins = units_of_country(admins, country)
    active = cut_lineage(active_users(budgets, activity))
    units = cut_lineage(home_units(labelled, admins, active, bins, labels, country))
    residents = labelled.join(units.select("user_id"), "user_id", "left_semi")
    moves = home_moves(add_urban_rural(residents, admins), seed)
    return cut_lineage(mover_counts(moves, units, country)), user_info(units, active, country)


def country_migration(labelled: DataFrame, budgets: DataFrame, admins: DataFrame, bins: Sequence[float],
                      labels: Sequence[str], country: str, activity: ActivityParams = ActivityParams(level=0.2),
                      seed: int = 0) -> DataFrame:
    """H7: the same counts for residents who have a home stop in a rural unit."""
    admins = units_of_country(admins, country)
    active = cut_lineage(active_users(budgets, activity))
    residents = metro_residents(labelled, main_metro_units(admins, bins, labels), active)
    rural = urban_rural(admins).where(F.col("urban_rural") == "rural")
    seen_rural = (
        residents.where(F.col("location_type") == "H").join(rural, "geom_id", "left_semi").select("user_id").distinct()
    )
    units = home_units(residents, admins, active, bins, labels, country)
    moves = home_moves(add_urban_rural(residents.join(seen_rural, "user_id", "left_semi"), admins), seed)
    return mover_counts(moves, units, country)


def migration_of_countries(labelled: DataFrame, budgets: DataFrame, admins: DataFrame, bins: Sequence[float],
                           labels: Sequence[str], activity: Mapping[str, ActivityParams], seen_rural: bool = False,
                           seed: int = 0) -> DataFrame:
    """H6, or H7 if ``seen_rural``, for all countries in one plan.

    Pieces, budgets and units carry ``country``; every user and every unit is known by it and
    its id, so ids of different countries may collide, and a user seen in two countries is
    one user in each.  ``activity`` gives each country's parameters; countries without any
    are left out.
    """
    require_columns(labelled, "country", "user_id", "geom_id", "location_type")
    user, unit = ["country", "user_id"], ["country", "geom_id"]
    active = cut_lineage(active_users_by_country(budgets, activity))
    metro = main_metro_units(admins, bins, labels)
    homes = labelled.join(active.select(*user), user, "left_semi").join(metro.select(*unit), unit, "left_semi")
    residents = cut_lineage(
        modal_admin_unit(homes, "H", "geom_id", keys=user).join(metro, unit).select(*user, "wealth_label"))
    stops = labelled.join(residents.select(*user), user, "left_semi")
    if seen_rural:
        rural = urban_rural(admins, unit).where(F.col("urban_rural") == "rural")
        at_rural_home = stops.where(F.col("location_type") == "H").join(rural, unit, "left_semi").select(*user).distinct()
        stops = stops.join(at_rural_home, user, "left_semi")
    moves = home_moves(add_urban_rural(stops, admins, unit), seed, user)
    return (
        moves.join(residents, user)
        .groupBy(F.col("date_trunc").alias("date"), "wealth_label", "change", "country")
        .agg(F.count_distinct("user_id").alias("n_users"))
        .select("date", "wealth_label", "change", "n_users", "country"))
