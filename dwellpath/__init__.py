"""GPS mobility analytics as Spark DataFrame operators."""

from dwellpath.functions.selection import exact_medians
from dwellpath.operators.admin import (
    add_urban_rural,
    main_metro,
    main_metro_units,
    metro_population,
    metro_units,
    units_of_country,
    urban_rural,
    wealth_percentile,
    with_wealth_label,
)
from dwellpath.operators.budgets import (
    active_users,
    active_users_by_country,
    daily_metrics,
    metrics_with_admins,
    modal_admin_unit,
    time_budgets,
)
from dwellpath.operators.clusters import CLUSTER_RADIUS_M, cluster_stops, most_frequent_label, recluster
from dwellpath.operators.days import add_time_fields, day_pieces, split_at_midnight
from dwellpath.operators.indicators import (
    change_from_baseline,
    difference_from_baseline,
    indicator,
    indicator_results,
    indicators,
    metric_by_label,
    smooth_metric,
    smoothed_range,
    weight_by_home,
    weight_by_home_and_work,
)
from dwellpath.operators.labels import (
    active_day_share,
    daily_pick,
    day_share,
    fill_gaps,
    home_evidence,
    initialise_labels,
    label_home,
    label_home_and_work,
    label_work,
    night_pieces,
    select_label_columns,
    start_hour_histogram,
    work_evidence,
    work_hour_pieces,
)
from dwellpath.operators.migration import (
    home_moves,
    home_units,
    metro_residents,
    mover_counts,
    mover_shares,
    net_rural,
    net_rural_by_label,
    smooth_migration,
    user_info,
)
from dwellpath.operators.pings import (
    drop_inaccurate,
    hourly_share,
    localise,
    most_observed_users,
    validate_pings,
    validation_report,
)
from dwellpath.operators.stops import detect_stops, find_stop_locations, label_pings, sessionise
from dwellpath.params import ActivityParams, LabelParams, StopParams
from dwellpath.plans.pipelines import (
    city_migration,
    country_migration,
    indicators_of,
    labelled_pieces_of,
    migration_of_countries,
)
from dwellpath.session import cut_for_joins, cut_lineage, remove_stages
from dwellpath.sources.stages import clean_stage, read_stage, write_stage
from dwellpath.sources.tables import prepare_pings, read_admins, read_pings

__all__ = [name for name in dir() if not name.startswith("_")]
