"""Stops cut into calendar days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.functions.times import full_hour, sunday_weekday
from dwellpath.schema import require_columns
from dwellpath.session import require_utc

_DAY = 86_400


def split_at_midnight(stops: DataFrame) -> DataFrame:
    """One row per calendar day a stop touches.

    ``total_duration_stop_location`` keeps the uncut length and ``duration`` is that of
    the piece.  Stops of zero length vanish; one that ends before it starts stays as
    it is.  The number of pieces follows the length of the stop, and no shuffle occurs.
    """
    require_columns(stops, "t_start", "t_end")
    days = F.sequence(F.floor(F.col("t_start") / _DAY), F.floor(F.col("t_end") / _DAY))
    cut = F.transform(days, lambda day: F.struct(
        F.greatest(F.col("t_start"), day * _DAY).alias("t_start"),
        F.least(F.col("t_end"), (day + 1) * _DAY).alias("t_end"),
    ))
    pieces = F.when(F.col("t_end") < F.col("t_start"), F.array(F.struct("t_start", "t_end"))).otherwise(
        F.filter(cut, lambda piece: piece["t_start"] < piece["t_end"]))
    kept = [c for c in stops.columns if c not in ("t_start", "t_end", "total_duration_stop_location", "duration")]
    return (
        stops.select(*kept, (F.col("t_end") - F.col("t_start")).alias("total_duration_stop_location"),
                     F.explode(pieces).alias("_piece"))
        .select(*kept, "total_duration_stop_location", "_piece.t_start", "_piece.t_end",
                (F.col("_piece.t_end") - F.col("_piece.t_start")).alias("duration"))
    )


def add_time_fields(pieces: DataFrame) -> DataFrame:
    """C11: hours of start and end, weekday (1 = Sunday), timestamp and day of the start."""
    require_utc(pieces.sparkSession)
    require_columns(pieces, "t_start", "t_end")
    start = F.timestamp_seconds("t_start")
    return pieces.withColumns({
        "t_start_hour": full_hour(F.col("t_start")),
        "t_end_hour": full_hour(F.col("t_end")),
        "weekday": sunday_weekday(F.col("t_start")),
        "date": start,
        "date_trunc": F.to_date(start),
    })


def day_pieces(stops: DataFrame) -> DataFrame:
    """C10 and C11 in one go."""
    return add_time_fields(split_at_midnight(stops))
