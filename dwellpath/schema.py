"""Column names and table schemas shared by every operator.

Every operator takes and returns Spark DataFrames in these shapes.  Times are
epoch seconds (``long``), coordinates are degrees (``double``), and the user key
is always ``user_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

PINGS = _struct(
    ("user_id", _S), ("ping_id", _L), ("epoch_time", _L), ("lat", _D), ("lon", _D),
    ("accuracy", _D), ("country", _S),
)

STOPS = _struct(
    ("user_id", _S), ("t_start", _L), ("t_end", _L), ("lat", _D), ("lon", _D),
    ("median_accuracy", _D), ("total_pings_stop", _L),
)

CLUSTERED_STOPS = T.StructType([*STOPS.fields, T.StructField("cluster_label", _L, True)])

HISTORY_STOPS = T.StructType([
    *CLUSTERED_STOPS.fields,
    T.StructField("total_duration_stop_location", _L, True),
    T.StructField("duration", _L, True),
])

DAY_PIECES = T.StructType([
    *HISTORY_STOPS.fields,
    T.StructField("date", T.TimestampType(), True),
    T.StructField("date_trunc", T.DateType(), True),
    T.StructField("t_start_hour", _I, True),
    T.StructField("t_end_hour", _I, True),
    T.StructField("weekday", _I, True),
    T.StructField("geom_id", _S, True),
])

LABELLED_PIECES = T.StructType([
    *DAY_PIECES.fields,
    T.StructField("location_type", _S, True),
    T.StructField("home_label", _L, True),
    T.StructField("work_label", _L, True),
])

BUDGETS = _struct(
    ("user_id", _S), ("date_trunc", T.DateType()), ("day_night", _S), ("H", _D), ("W", _D), ("O", _D),
    ("absolute_H", _L), ("absolute_W", _L), ("absolute_O", _L),
)

ADMINS = _struct(
    ("country", _S), ("geom_id", _S), ("metro_area_name", _S), ("pop", _D), ("wealth_index", _D),
)

LOCATION_TYPES = ("H", "W", "O")


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail early, on the driver, when an operator's input lacks a column."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
