"""Parameters of the operators, with the defaults the method was calibrated for."""

from __future__ import annotations

from dataclasses import dataclass
from math import frexp

EARTH_RADIUS_M = 6_371_000.0


@dataclass(frozen=True)
class StopParams:
    """Stop detection.

    ``max_gap`` and ``min_stay`` are seconds; ``None`` switches the time test off.
    ``accuracy_includes_last`` decides whether the median accuracy of a stop covers
    its last ping.  ``period_seconds`` is the stretch of time a user's pings are first
    searched by; it changes the partitioning only, never the result.  Above a radius of
    10 km no jump in space ends a stop for sure, so units are then cut by time alone.
    ``coordinate_step``, a power of two such as 2**-24 degrees (about 7 mm), first takes
    coordinates to whole multiples of it.  Medians are then exact sums of such multiples,
    so no engine's rounding decides which ping joins a stop or where a stop lies.
    """

    radius_m: float = 50.0
    min_stay: int | None = 300
    min_size: int = 2
    max_gap: int | None = 3600
    metric: str = "haversine"
    accuracy_includes_last: bool = False
    period_seconds: int = 86_400
    coordinate_step: float | None = None

    def __post_init__(self) -> None:
        if self.metric not in ("haversine", "euclidean"):
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.radius_m <= 0 or self.min_size < 1:
            raise ValueError("radius_m must be positive and min_size at least 1")
        if self.coordinate_step is not None and frexp(self.coordinate_step)[0] != 0.5:
            raise ValueError("coordinate_step must be a power of two")

    @classmethod
    def untimed(cls, **kw) -> "StopParams":
        """The variant that looks at space only."""
        return cls(**{"min_stay": None, "max_gap": None, **kw})


@dataclass(frozen=True)
class LabelParams:
    """Home and work labelling.

    Hours bound the active day.  A cluster needs ``int(min_periods * window)``
    observed days inside the trailing calendar window to be a candidate.
    """

    start_hour_day: int = 5
    end_hour_day: int = 23
    min_pings_home: int = 2
    home_window_days: int = 14
    home_min_periods: float = 0.2
    work_min_seconds: float = 60.0
    work_window_days: int = 28
    work_min_periods: float = 0.2

    @property
    def home_min_days(self) -> int:
        return int(self.home_min_periods * self.home_window_days)

    @property
    def work_min_days(self) -> int:
        return int(self.work_min_periods * self.work_window_days)


@dataclass(frozen=True)
class ActivityParams:
    """Which days count towards a user's activity, and how active is active.

    Days from ``start`` (if given) up to but excluding ``end`` count; ``split``
    separates the ``pre`` from the ``post`` period.
    """

    level: float = 0.0
    start: str | None = None
    split: str = "2020-03-15"
    end: str = "2021-01-01"

    @classmethod
    def for_country(cls, country: str, level: float = 0.0) -> "ActivityParams":
        # Fixed value: Indonesia's panel changed in January 2020.
        return cls(level=level, start="2020-02-01" if country == "ID" else None)
