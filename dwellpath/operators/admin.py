"""Admin units and wealth.

Admin tables hold one row per unit, so the ordered sums below run over the units of one
country or metro area.  Joins against them carry no broadcast hint: Spark broadcasts
them by their measured size and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.functions.binning import bin_label
from dwellpath.schema import require_columns


def units_of_country(admins: DataFrame, country: str) -> DataFrame:
    """The units of one country.  Unit ids are only unique within a country, so joins by unit start from here."""
    require_columns(admins, "country", "geom_id")
    return admins.where(F.col("country") == country)


def wealth_percentile(admins: DataFrame, by_metro: bool = False) -> DataFrame:
    """``pct_wealth``, the population share of the units at least as rich; near 0 is richest.

    Counted within the country, or within the metro area of a country.
    """
    keys = ["country", "metro_area_name"] if by_metro else ["country"]
    require_columns(admins, *keys, "geom_id", "pop", "wealth_index")
    names = [*keys, "geom_id", "pop", "wealth_index"]
    units = Window.partitionBy(*keys)
    richer = units.orderBy(F.col("wealth_index").desc(), "geom_id").rowsBetween(Window.unboundedPreceding, 0)
    return admins.select(*names).dropna().withColumn(
        "pct_wealth", F.try_divide(F.sum("pop").over(richer), F.sum("pop").over(units)))


def urban_rural(admins: DataFrame, keys: Sequence[str] = ("geom_id",)) -> DataFrame:
    """'rural' for units outside any metro area; ``keys`` name a unit."""
    flag = F.when(F.col("metro_area_name").isNull(), "rural").otherwise("urban")
    return admins.select(*keys, flag.alias("urban_rural"))


def metro_population(admins: DataFrame) -> DataFrame:
    """population per metro area of units without gaps in their data."""
    complete = admins.select("country", "geom_id", "metro_area_name", "pop", "wealth_index").dropna()
    return complete.groupBy("country", "metro_area_name").agg(F.sum("pop").alias("pop"))


def main_metro(admins: DataFrame) -> DataFrame:
    """the largest metro area per country; ties to the first name."""
    best = F.min(F.struct((-F.col("pop")).alias("rank"), "metro_area_name"))
    return metro_population(admins).groupBy("country").agg(best.alias("_best")).select(
        "country", F.col("_best.metro_area_name").alias("metro_area_name"))


def with_wealth_label(units: DataFrame, bins: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """``wealth_label`` from ``pct_wealth``; NULL outside the bins."""
    require_columns(units, "pct_wealth")
    return units.withColumn("wealth_label", bin_label(F.col("pct_wealth"), bins, labels))


def metro_units(admins: DataFrame, bins: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """units of metro areas with the wealth label inside their area."""
    return with_wealth_label(wealth_percentile(admins, by_metro=True), bins, labels)


def main_metro_units(admins: DataFrame, bins: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """F5 restricted to the main metro area of each country."""
    return metro_units(admins, bins, labels).join(main_metro(admins), ["country", "metro_area_name"], "left_semi")


def add_urban_rural(stops: DataFrame, admins: DataFrame, keys: Sequence[str] = ("geom_id",)) -> DataFrame:
    """flag of the stop's unit; stops outside known units are dropped."""
    require_columns(stops, *keys)
    return stops.join(urban_rural(admins, keys), list(keys))
