"""Row-framed rolling statistics over date-ordered series."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def centred_frame(order: WindowSpec, rows: int) -> WindowSpec:
    """``rows`` rows around the current one; an even width leans to the past."""
    return order.rowsBetween(-(rows // 2), (rows - 1) // 2)


def trailing_frame(order: WindowSpec, rows: int) -> WindowSpec:
    return order.rowsBetween(-(rows - 1), 0)


def guarded(column: str, statistic: Column, frame: WindowSpec, min_rows: int) -> Column:
    """``statistic`` over ``frame`` where it holds at least ``min_rows`` values."""
    return F.when(F.count(F.col(column)).over(frame) >= min_rows, statistic.over(frame))


def rolling_sem(column: str, frame: WindowSpec, min_rows: int, divide_by_n_minus_1: bool = False) -> Column:
    """Standard error of the values in ``frame``; NULL for fewer than two."""
    count = F.count(F.col(column)).over(frame)
    spread = F.stddev_samp(F.col(column)).over(frame)
    divisor = count - 1 if divide_by_n_minus_1 else count
    return F.when(count >= F.lit(max(min_rows, 2)), spread / F.sqrt(divisor.cast("double")))
