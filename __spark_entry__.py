
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import dwellpath as dp  # noqa: E402
import oracles  # noqa: E402
from dwellpath import schema  # noqa: E402
from dwellpath.session import ensure_checkpoint_dir  # noqa: E402
from dwellpath.sources import sample  # noqa: E402

# Fixed values for the sample data, shared with the oracles.
ACTIVITY = dp.ActivityParams(level=oracles.ACTIVE_SHARE, split=oracles.SPLIT, end=oracles.END)
ACTIVITIES = {"C0": ACTIVITY, "C1": ACTIVITY, "C2": dp.ActivityParams(
    level=oracles.ACTIVE_SHARE_C2, split=oracles.SPLIT, end=oracles.END)}
BINS, LABELS = oracles.BINS, oracles.LABELS
BASELINE = (oracles.BASE_FROM, oracles.BASE_TO)
CROP = (oracles.CROP_FROM, oracles.CROP_TO)
WINDOW = oracles.WINDOW
COUNTRY = "XX"
RANGE = ("2024-01-02", "2024-01-29")
# Untimed, on coordinates that are whole multiples of 2^-24 degrees.
EXACT = dp.StopParams.untimed(coordinate_step=2.0 ** -24)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: pings to labelled day pieces on the smallest sample."""
    return _tidy(dp.select_label_columns(Stages.of(spark, "/root/testdata/sf0.001").labelled))


class Stages:
    """The stages of one sample, each derived from the driver's tables when first asked for.

    Stages that several queries read are written once, as a production run would
    persist them.
    """

    _known: dict[tuple[str, str], "Stages"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Stages":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def pings(self) -> DataFrame:
        return self._once("pings", lambda: sample.sample_pings(self.spark, self.sf_dir))

    @property
    def zones(self) -> DataFrame:
        return self._once("zones", lambda: sample.sample_zones(self.spark))

    @property
    def admins(self) -> DataFrame:
        return self._once("admins", lambda: sample.sample_admins(self.spark, self.sf_dir))

    @property
    def admins3(self) -> DataFrame:
        return self._once("admins3", lambda: sample.sample_admins(self.spark, self.sf_dir, countries=3))

    @property
    def detected(self) -> DataFrame:
        return self._once("detected", lambda: dp.detect_stops(self.pings))

    @property
    def hard_pings(self) -> DataFrame:
        return self._once("hard_pings", lambda: sample.sample_hard_pings(self.spark, self.sf_dir))

    @property
    def hard_clustered(self) -> DataFrame:
        return self._once("hard_clustered", lambda: dp.cut_lineage(dp.find_stop_locations(self.hard_pings)))

    @property
    def clustered(self) -> DataFrame:
        return self._once("clustered", lambda: dp.cut_lineage(dp.find_stop_locations(self.pings)))

    @property
    def pieces(self) -> DataFrame:
        return self._once("pieces", lambda: sample.with_geom_id(
            dp.day_pieces(self.clustered), self.spark, self.sf_dir))

    @property
    def homes(self) -> DataFrame:
        return dp.label_home(self.pieces).where(F.col("location_type") == "H")

    @property
    def labelled(self) -> DataFrame:
        return self._once("labelled", lambda: dp.cut_lineage(dp.label_home_and_work(self.pieces)))

    @property
    def budgets(self) -> DataFrame:
        return self._once("budgets", lambda: dp.cut_lineage(dp.time_budgets(self.labelled)))

    @property
    def metrics(self) -> DataFrame:
        return self._once("metrics", lambda: dp.cut_for_joins(
            dp.metrics_with_admins(self.labelled, self.budgets, ACTIVITY)))

    @property
    def wealth(self) -> DataFrame:
        return self._once("wealth", lambda: dp.wealth_percentile(self.admins))

    @property
    def by_home(self) -> DataFrame:
        return dp.weight_by_home(self.metrics, self.wealth, BINS, LABELS)

    @property
    def by_home_and_work(self) -> DataFrame:
        return dp.weight_by_home_and_work(self.metrics, self.wealth, BINS, LABELS)

    @property
    def results(self) -> DataFrame:
        return self._once("results", lambda: dp.indicators_of(
            self.labelled, self.admins, BINS, LABELS, COUNTRY, ACTIVITY))

    @property
    def active(self) -> DataFrame:
        return dp.active_users(self.budgets, ACTIVITY)

    @property
    def moves(self) -> DataFrame:
        return dp.home_moves(dp.add_urban_rural(self.labelled, self.admins))

    @property
    def city(self) -> tuple[DataFrame, DataFrame]:
        return self._once("city", lambda: dp.city_migration(
            self.labelled, self.budgets, self.admins, BINS, LABELS, COUNTRY, ACTIVITY))

    @property
    def budgets_by_country(self) -> DataFrame:
        return sample.with_country_of_user(self.budgets)

    @property
    def by_country(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pieces, budgets and units of three countries whose unit ids collide."""
        return (sample.with_colliding_ids(sample.with_country_of_user(self.labelled)), self.budgets_by_country,
                sample.with_colliding_ids(self.admins3))

    @property
    def net_rural_wide(self) -> DataFrame:
        return dp.net_rural_by_label(*self.city, COUNTRY, oracles.END, LABELS, BASELINE)

    def metric(self, name: str) -> DataFrame:
        return dp.metric_by_label(self.results, name, COUNTRY, LABELS, *BASELINE,
                                  groups=["wealth_label_home", "wealth_label_work"])


_QUERIES: dict[str, Callable[[Stages], DataFrame]] = {
    "a1_read_pings": lambda s: _through_parquet(
        s.pings.select(F.col("user_id").alias("uid"), "ping_id", F.timestamp_seconds("epoch_time").alias("datetime"),
                       "country", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                       F.col("accuracy").alias("horizontal_accuracy"))),
    "a3_labelled_stage": lambda s: _through_stage(s.labelled, schema.LABELLED_PIECES),
    "a3_budget_stage": lambda s: _through_stage(s.budgets, schema.BUDGETS),
    "a4_read_admins": lambda s: _through_csv(s.admins),
    "a5_stage_round_trip": lambda s: _through_stage(s.pings),
    "a5_two_countries": lambda s: _country_by_country(s.pings),
    "b1_validate": lambda s: dp.validation_report(s.pings),
    "b1_drop_invalid": lambda s: dp.validate_pings(
        s.pings.withColumn("lat", F.col("lat") * 3).withColumn("lon", F.col("lon") * 2), "drop"),
    "b2_localise": lambda s: dp.localise(s.pings, s.zones).select("user_id", "ping_id", "epoch_time"),
    "b3_top_user": lambda s: dp.most_observed_users(s.pings),
    "b4_hour_share": lambda s: dp.hourly_share(s.pings),
    "b4_hour_share_local": lambda s: dp.hourly_share(dp.localise(s.pings, s.zones)),
    "b5_accurate_stops": lambda s: dp.drop_inaccurate(s.detected),
    "b6_label_columns": lambda s: dp.select_label_columns(s.labelled),
    "c1_sessions": lambda s: dp.sessionise(s.pings).select("user_id", "ping_id", "session_id"),
    "c2_stops": lambda s: s.detected,
    "c2_stops_split_users": lambda s: dp.detect_stops(s.pings, dp.StopParams(period_seconds=3600)),
    "c2_stops_noisy": lambda s: dp.detect_stops(s.hard_pings),
    "c3_stops_noisy": lambda s: dp.detect_stops(s.hard_pings, EXACT),
    "c2_stops_one_device": lambda s: dp.detect_stops(sample.sample_one_device(s.spark, s.sf_dir)),
    "c2_stops_through_days": lambda s: dp.detect_stops(
        sample.sample_one_device(s.spark, s.sf_dir), dp.StopParams(period_seconds=3600, radius_m=150)),
    "c2_ping_labels_noisy": lambda s: dp.label_pings(s.hard_pings),
    "c3_ping_labels_noisy": lambda s: dp.label_pings(s.hard_pings, EXACT),
    "c5_group_medians": lambda s: dp.exact_medians(
        s.hard_pings.select("country", F.col("lat").alias("value")), ["country"]),
    "c6_clusters_chained": lambda s: s.hard_clustered,
    "c9_recluster_chained": lambda s: dp.recluster(*_before_and_after(s.hard_clustered)),
    "c9_recluster_touched": lambda s: dp.recluster(
        *_before_and_after(s.clustered), history_radius_m=dp.CLUSTER_RADIUS_M),
    "c9_recluster_all": lambda s: dp.recluster(*_before_and_after(s.hard_clustered), history_radius_m=None),
    "c9_recluster_earlier": lambda s: dp.recluster(*reversed(_before_and_after(s.hard_clustered))),
    "c2_ping_labels": lambda s: dp.label_pings(s.pings),
    "c3_stops_untimed": lambda s: dp.detect_stops(s.pings, dp.StopParams.untimed()),
    "c5_stops_all_accuracies": lambda s: dp.detect_stops(s.pings, dp.StopParams(accuracy_includes_last=True)),
    "c6_clusters": lambda s: s.clustered,
    "c7_stop_locations": lambda s: dp.find_stop_locations(s.pings),
    "c9_recluster": lambda s: dp.recluster(*_before_and_after(s.clustered)),
    "c10_day_split": lambda s: dp.split_at_midnight(s.clustered),
    "c11_time_fields": lambda s: dp.day_pieces(s.clustered),
    "c12_mode_label": lambda s: dp.most_frequent_label(s.clustered, ["user_id"]),
    "d2_night_pieces": lambda s: dp.night_pieces(s.pieces).select("user_id", "t_start", "cluster_label"),
    "d3_home_evidence": lambda s: dp.home_evidence(s.pieces),
    "d4_daily_home": lambda s: dp.daily_pick(dp.home_evidence(s.pieces)),
    "d5_home_days": lambda s: dp.fill_gaps(dp.daily_pick(dp.home_evidence(s.pieces))).withColumn(
        "observed", F.col("observed").cast("long")),
    "d6_home": lambda s: dp.label_home(s.pieces),
    "d7_work_hours": lambda s: dp.work_hour_pieces(s.pieces, s.homes).select("user_id", "t_start", "cluster_label"),
    "d8_work_evidence": lambda s: dp.work_evidence(s.pieces, s.homes),
    "d10_work_days": lambda s: dp.fill_gaps(dp.daily_pick(dp.work_evidence(s.pieces, s.homes))).withColumn(
        "observed", F.col("observed").cast("long")),
    "d11_work": lambda s: dp.label_work(dp.label_home(s.pieces)),
    "d12_labels": lambda s: dp.label_home_and_work(s.pieces),
    "d13_day_share": lambda s: dp.day_share(s.pieces),
    "d14_active_share": lambda s: dp.active_day_share(s.pieces, dp.LabelParams().home_window_days),
    "d15_start_hours": lambda s: dp.start_hour_histogram(s.labelled),
    "e1_budget": lambda s: s.budgets,
    "e2_active": lambda s: s.active,
    "e3_daily": lambda s: dp.daily_metrics(s.budgets, ACTIVITY),
    "e4_modal_home": lambda s: dp.modal_admin_unit(s.labelled, "H", "geom_id_home", until=oracles.SPLIT),
    "e4_modal_work": lambda s: dp.modal_admin_unit(s.labelled, "W", "geom_id_work"),
    "e5_attach": lambda s: s.metrics,
    "f1_wealth_country": lambda s: s.wealth,
    "f1_wealth_countries": lambda s: dp.wealth_percentile(sample.sample_admins(s.spark, s.sf_dir, countries=3)),
    "f1_wealth_metro": lambda s: dp.wealth_percentile(s.admins, by_metro=True),
    "f2_urban_rural_units": lambda s: dp.urban_rural(s.admins),
    "f3_metro_pop": lambda s: dp.metro_population(s.admins),
    "f3_main_metro": lambda s: dp.main_metro(sample.sample_admins(s.spark, s.sf_dir, countries=3)),
    "f4_bins": lambda s: dp.with_wealth_label(s.wealth, BINS, LABELS),
    "f5_metro_units": lambda s: dp.metro_units(s.admins, BINS, LABELS),
    "f6_urban_rural": lambda s: dp.add_urban_rural(
        s.labelled.select("user_id", "t_start", "cluster_label", "geom_id"), s.admins),
    "g1_weights": lambda s: s.by_home,
    "g2_weights_hw": lambda s: s.by_home_and_work,
    "g3_indicator": lambda s: dp.indicator(s.by_home, "H"),
    "g4_indicator_hw": lambda s: dp.indicator(s.by_home_and_work, "C", ["wealth_label_home", "wealth_label_work"]),
    "g4_results": lambda s: s.results,
    "g5_change": lambda s: dp.change_from_baseline(
        dp.indicator(s.by_home, "H"), *BASELINE, groups=["wealth_label_home"]),
    "g5_change_shared": lambda s: dp.change_from_baseline(dp.indicator(s.by_home, "O"), *BASELINE),
    "g6_diff": lambda s: dp.difference_from_baseline(
        dp.indicator(s.by_home, "H").drop("mean").withColumnRenamed("n_unique", "users"), "users", *BASELINE,
        groups=["wealth_label_home"]),
    "g7_wide": lambda s: s.metric("t_home"),
    "g7_wide_hw": lambda s: s.metric("comms_hw"),
    "g7_range": lambda s: dp.smoothed_range(s.metric("t_other"), LABELS, *RANGE, WINDOW),
    "g8_smooth": lambda s: dp.smooth_metric(s.metric("t_home"), LABELS, *CROP, WINDOW),
    "g8_smooth_partial": lambda s: dp.smooth_metric(
        s.metric("t_other"), LABELS, *CROP, 28, min_rows=1, crop_first=True),
    "h1_metro_residents": lambda s: dp.metro_residents(
        s.labelled, dp.main_metro_units(s.admins, BINS, LABELS), s.active).select("user_id", "t_start", "cluster_label"),
    "h2_home_unit": lambda s: dp.home_units(s.labelled, s.admins, s.active, BINS, LABELS, COUNTRY),
    "h2_home_unit_countries": lambda s: _each_country(lambda country: dp.home_units(
        s.labelled, s.admins3, s.active, BINS, LABELS, country)),
    "h6_city_countries": lambda s: _each_country(lambda country: dp.city_migration(
        s.labelled, s.budgets, s.admins3, BINS, LABELS, country, ACTIVITY)[0]),
    "h3_user_info": lambda s: s.city[1],
    "h4_moves": lambda s: s.moves.select(
        "user_id", "t_start", "geom_id", "prev_geom_id", "urban_rural", "prev_urban_rural", "change", "gap",
        "rand_gap", "date_trunc"),
    "h5_mover_counts": lambda s: dp.mover_counts(
        s.moves, dp.home_units(s.labelled, s.admins, s.active, BINS, LABELS, COUNTRY), COUNTRY),
    "h6_city": lambda s: s.city[0],
    "e2_active_countries": lambda s: dp.active_users_by_country(s.budgets_by_country, ACTIVITIES),
    "h6_city_colliding_ids": lambda s: dp.migration_of_countries(*s.by_country, BINS, LABELS, ACTIVITIES),
    "h7_country_countries": lambda s: dp.migration_of_countries(*s.by_country, BINS, LABELS, ACTIVITIES, seen_rural=True),
    "h7_country": lambda s: dp.country_migration(
        s.labelled, s.budgets, s.admins, BINS, LABELS, COUNTRY, ACTIVITY),
    "h8_mover_shares": lambda s: dp.mover_shares(s.city[0], COUNTRY, oracles.END),
    "h8_net_rural": lambda s: dp.net_rural(*s.city, COUNTRY, oracles.END),
    "h8_net_rural_wide": lambda s: s.net_rural_wide,
    "h9_smooth": lambda s: dp.smooth_migration(s.net_rural_wide, LABELS, *CROP, WINDOW),
    "h9_smooth_pandas_sem": lambda s: dp.smooth_migration(s.net_rural_wide, LABELS, *CROP, WINDOW, pandas_sem=True),
}


MOBILITY_QUERIES = frozenset(_QUERIES)


def _before_and_after(stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = F.unix_timestamp(F.lit(oracles.SPLIT), "yyyy-MM-dd")
    return stops.where(F.col("t_start") < split), stops.where(F.col("t_start") >= split)


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/exchange/{uuid.uuid4().hex}"


def _through_csv(admins: DataFrame) -> DataFrame:
    root = _folder(admins.sparkSession)
    admins.drop("country").write.option("header", "true").csv(f"{root}/{COUNTRY}/admin.csv")
    return dp.read_admins(admins.sparkSession, root, COUNTRY)


def _through_parquet(raw: DataFrame) -> DataFrame:
    path = f"{_folder(raw.sparkSession)}/raw"
    raw.write.parquet(path)
    return dp.read_pings(raw.sparkSession, path)


def _through_stage(rows: DataFrame, kind: T.StructType | None = None) -> DataFrame:
    root, run = _folder(rows.sparkSession), {"radius": 50, "gap": 3600}
    stage = rows if "country" in rows.columns else rows.withColumn("country", F.lit(COUNTRY))
    dp.write_stage(stage, root, "stage", run)
    return dp.read_stage(rows.sparkSession, root, "stage", run, schema=kind)


def _country_by_country(pings: DataFrame) -> DataFrame:
    """One stage, written by one call per country."""
    root, run = _folder(pings.sparkSession), {"radius": 50}
    for country in sorted(sample.ZONES):
        dp.write_stage(pings.where(F.col("country") == country), root, "pings", run)
    return dp.read_stage(pings.sparkSession, root, "pings", run)


def _each_country(make: Callable[[str], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [make(country) for country in ("C0", "C1", "C2")])


def _tidy(df: DataFrame) -> DataFrame:
    """Plain column types for the comparison: dates as text, whole numbers as long, doubles rounded."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.TimestampType):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            value = value.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value, 6) + F.lit(0.0)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _training_text() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL for training text; none if that subpackage or its pipeline is not there."""
    try:
        import corpus_pipeline
        from dwellpath.llm import queries as llm
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "dwellpath.llm", "dwellpath.llm.queries"):
            raise
        return {}, {}
    pipeline_sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**llm.QUERIES, "pipeline": corpus_pipeline.run}, {**llm.ORACLE_SQL, **pipeline_sql}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(make: Callable[[Stages], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: _tidy(make(Stages.of(spark, sf_dir)))

    return {name: bind(make) for name, make in _QUERIES.items()} | _training_text()[0]


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | _training_text()[1]
