"""Column expressions."""

from dwellpath.functions.binning import bin_label
from dwellpath.functions.geo import distance, euclidean, haversine_m
from dwellpath.functions.ranking import rank_in_time
from dwellpath.functions.series import centred_frame, guarded, rolling_sem, trailing_frame
from dwellpath.functions.times import day_number, digest28, full_hour, monday_weekday, sunday_weekday

__all__ = [
    "bin_label", "centred_frame", "day_number", "digest28", "distance", "euclidean", "full_hour",
    "guarded", "haversine_m", "monday_weekday", "rank_in_time", "rolling_sem", "sunday_weekday",
    "trailing_frame",
]
