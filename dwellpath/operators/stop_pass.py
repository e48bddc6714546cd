"""The one sequential step: growing stops around a running median.

Whether a ping belongs to the current stop depends on every earlier decision, so no
SQL window expresses it.  This module holds the bodies of two ``mapInArrow`` passes over
pings that Spark has already partitioned and sorted.  Both cut the stream wherever a stop
must end whatever came before, settle units that stay in one spot with numpy, and walk
only the rest ping by ping.

Where a stop must end.  A ping joins the current stop only within ``r`` of its median,
and adding it moves each coordinate of the median towards the ping, never past it.  So
the median is always within ``r`` of the latest member, and a ping farther than ``2 r``
from its predecessor is farther than ``r`` from the median.  Such a jump, like a gap in
time, starts from a clean state: the pings on both sides are independent.

The first pass sees a user's pings period by period.  What lies between two sure ends is
complete there.  What touches an edge of the period, a *unit*, is searched as if a stop
began at its first ping, and handed on with the groups found so and a summary; how units
join is settled in :mod:`dwellpath.operators.stop_chains`.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dwellpath.params import EARTH_RADIUS_M, StopParams

STOP_FIELDS = pa.schema([
    ("user_id", pa.string()), ("t_start", pa.int64()), ("t_end", pa.int64()), ("lat", pa.float64()),
    ("lon", pa.float64()), ("median_accuracy", pa.float64()), ("total_pings_stop", pa.int64()),
    ("first_ping", pa.int64()), ("last_ping", pa.int64()),
])
SEARCH_FIELDS = pa.schema([
    *STOP_FIELDS, ("kind", pa.int32()), ("unit", pa.int64()), ("place", pa.int64()), ("opened", pa.int64()),
    ("marks", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64())),
])
STOP, PING, SUMMARY = 0, 1, 2

# Pings of a run that are held against its median one by one before whole slices are tried.
SINGLY = 64

# Bins per radius of the counts that summaries carry.
BINS_PER_RADIUS = 32

# The jump rule needs lon differences that do not wrap and a slowly varying cos(lat).
JUMP_MAX_RADIUS_M = 10_000.0
JUMP_MAX_LAT = 80.0
JUMP_MAX_LON = 179.0


def jump_threshold(params: StopParams) -> float:
    """Distance to the previous ping beyond which a stop surely ends."""
    if params.metric == "euclidean":
        return 2.0 * params.radius_m * (1 + 1e-9)
    if params.radius_m > JUMP_MAX_RADIUS_M:
        return float("inf")
    return 2.05 * params.radius_m + 1e-3


class RunningMedian:
    """Median of a growing multiset in two heaps, the lower and the upper half; adding costs O(log n)."""

    __slots__ = ("low", "high")

    def __init__(self, values: np.ndarray) -> None:
        ordered = np.sort(values)
        middle = (len(ordered) + 1) // 2
        self.low, self.high = (-ordered[:middle])[::-1].tolist(), ordered[middle:].tolist()

    def add(self, value: float) -> None:
        low, high = self.low, self.high
        if value <= -low[0]:
            heapq.heappush(low, -value)
        else:
            heapq.heappush(high, value)
        if len(low) > len(high) + 1:
            heapq.heappush(high, -heapq.heappop(low))
        elif len(high) > len(low):
            heapq.heappush(low, -heapq.heappop(high))

    def value(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else 0.5 * (self.high[0] - self.low[0])


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    chord = (sin(radians(lat2 - lat1) / 2) ** 2
             + sin(radians(lon2 - lon1) / 2) ** 2 * cos(radians(lat1)) * cos(radians(lat2)))
    return 2 * EARTH_RADIUS_M * asin(min(1.0, sqrt(chord)))


def _units(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    return sqrt((lat1 - lat2) ** 2 + (lon1 - lon2) ** 2)


def _consecutive_distance(metric: str, lat1, lon1, lat2, lon2) -> np.ndarray:
    if metric == "euclidean":
        return np.hypot(lat1 - lat2, lon1 - lon2)
    chord = (np.sin(np.radians(lat2 - lat1) / 2) ** 2
             + np.sin(np.radians(lon2 - lon1) / 2) ** 2 * np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)))
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(chord)))


def _surely_apart(params: StopParams, lat1, lon1, lat2, lon2) -> np.ndarray:
    far = _consecutive_distance(params.metric, lat1, lon1, lat2, lon2) > jump_threshold(params)
    if params.metric == "haversine":
        far &= (np.abs(lat1) < JUMP_MAX_LAT) & (np.abs(lon1) < JUMP_MAX_LON)
    return far


def _surely_together(params: StopParams, south, north, west, east) -> np.ndarray:
    """Units whose bounding box is so small that every ping joins every median."""
    if params.metric == "euclidean":
        return np.hypot(north - south, east - west) <= params.radius_m * (1 - 1e-9)
    widest = np.where((south <= 0) & (north >= 0), 0.0, np.minimum(np.abs(south), np.abs(north)))
    high = np.radians(north - south) * EARTH_RADIUS_M
    wide = np.radians(east - west) * EARTH_RADIUS_M * np.cos(np.radians(widest))
    return np.hypot(high, wide) <= params.radius_m * 0.999


def _segment_medians(values: np.ndarray, owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Median of each run of ``sizes`` values beginning at ``starts``; NaN if the run is empty."""
    ordered = values[np.lexsort((values, owner))]
    low = starts + np.maximum(sizes - 1, 0) // 2
    high = np.minimum(starts + sizes // 2, len(values) - 1)
    return np.where(sizes > 0, 0.5 * (ordered[low] + ordered[high]), np.nan)


@dataclass
class _Pings:
    """Pings as columns."""

    user: pa.Array
    t: np.ndarray
    ping: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    accuracy: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> "_Pings":
        t, ping, lat, lon, accuracy = (
            (batch.column(name).fill_null(0) if name == "ping_id" else batch.column(name)).to_numpy(
                zero_copy_only=False).astype(kind, copy=False)
            for name, kind in (("epoch_time", np.int64), ("ping_id", np.int64), ("lat", np.float64), ("lon", np.float64),
                               ("accuracy", np.float64)))
        return cls(batch.column("user_id").cast(pa.string()), t, ping, lat, lon, accuracy)

    def cut(self, low: int, high: int) -> "_Pings":
        return _Pings(self.user.slice(low, high - low), *(
            column[low:high] for column in (self.t, self.ping, self.lat, self.lon, self.accuracy)))

    @staticmethod
    def joined(parts: list["_Pings"]) -> "_Pings":
        if len(parts) == 1:
            return parts[0]
        return _Pings(pa.concat_arrays([p.user for p in parts]), *(
            np.concatenate([getattr(p, name) for p in parts]) for name in ("t", "ping", "lat", "lon", "accuracy")))


def _settle_compact(pings: _Pings, begin, end, params: StopParams) -> pa.RecordBatch:
    """Stops of the units ``[begin, end)`` that are one stop as a whole."""
    sizes = end - begin
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.arange(sizes.sum()) - np.repeat(starts, sizes) + np.repeat(begin, sizes)
    used, last = pings.accuracy[rows].copy(), starts + sizes - 1
    unknown = np.isnan(used)
    if not params.accuracy_includes_last:
        used[last] = np.inf  # sorts behind the others, and is not counted below
        unknown[last] = False
    medians = _segment_medians(used, owner, starts, sizes if params.accuracy_includes_last else sizes - 1)
    medians = np.where(np.logical_or.reduceat(unknown, starts), np.nan, medians)
    return pa.RecordBatch.from_arrays([
        pings.user.take(pa.array(begin)),
        pa.array(pings.t[begin]),
        pa.array(pings.t[end - 1]),
        pa.array(_segment_medians(pings.lat[rows], owner, starts, sizes)),
        pa.array(_segment_medians(pings.lon[rows], owner, starts, sizes)),
        pa.array(medians, from_pandas=True),
        pa.array(sizes.astype(np.int64)),
        pa.array(pings.ping[begin]),
        pa.array(pings.ping[end - 1]),
    ], schema=STOP_FIELDS)


def _still_together(params: StopParams, pings: _Pings, low: int, high: int, box: tuple) -> int:
    """How many pings from ``low`` on keep the box of those before small enough for all to be one stop."""
    south, north, west, east = box
    lat, lon = pings.lat[low:high], pings.lon[low:high]
    small = _surely_together(
        params, np.minimum(np.minimum.accumulate(lat), south), np.maximum(np.maximum.accumulate(lat), north),
        np.minimum(np.minimum.accumulate(lon), west), np.maximum(np.maximum.accumulate(lon), east))
    return high - low if small.all() else int(np.argmin(small))


def _sure_bounds(params: StopParams) -> tuple[float, float]:
    """Squared difference of coordinates up to which two points are surely in reach, and that of latitudes beyond which not."""
    if params.metric == "euclidean":
        return (params.radius_m * (1 - 1e-9)) ** 2, params.radius_m * (1 + 1e-9)
    if params.radius_m > JUMP_MAX_RADIUS_M:
        return -1.0, float("inf")
    radius = float(np.degrees(params.radius_m / EARTH_RADIUS_M))
    return (radius * 0.999) ** 2, radius * 1.001


def groups_of_unit(pings: _Pings, params: StopParams) -> Iterator[tuple[int, int]]:
    """The runs of pings ``[first, end)`` of one unit that are grown together, one after the other.

    The first pings of a run are held against its median one by one, on plain numbers, since
    most runs of a noisy track end after a few.  Longer runs go on in :func:`_grown`.
    """
    dist = _metres if params.metric == "haversine" else _units
    radius, total, first = params.radius_m, len(pings.t), 0
    near, far = _sure_bounds(params)
    base, until, lat_of, lon_of = 0, 0, [], []
    while first < total:
        lats, lons, at, ended = [], [], first, False
        for size in range(min(SINGLY, total - first)):
            if at >= until:
                base, until = at, min(at + 4096, total)
                lat_of, lon_of = pings.lat[base:until].tolist(), pings.lon[base:until].tolist()
            lat, lon = lat_of[at - base], lon_of[at - base]
            if size:
                middle = size // 2
                middle_lat = lats[middle] if size % 2 else 0.5 * (lats[middle] + lats[middle - 1])
                middle_lon = lons[middle] if size % 2 else 0.5 * (lons[middle] + lons[middle - 1])
                high, wide = lat - middle_lat, lon - middle_lon
                ended = high * high + wide * wide > near and (
                    high > far or high < -far or dist(lat, lon, middle_lat, middle_lon) > radius)
                if ended:
                    break
            insort(lats, lat)
            insort(lons, lon)
            at += 1
        if not ended and at < total:
            at = _grown(pings, first, at, params)
        yield first, at
        first = at


def _grown(pings: _Pings, first: int, at: int, params: StopParams) -> int:
    """Where the run that holds the pings ``[first, at)`` ends.

    While its box is small it is extended by whole slices; only once it has outgrown that is
    every ping held against the running median.
    """
    dist = _metres if params.metric == "haversine" else _units
    radius, total, step = params.radius_m, len(pings.t), 64
    lat, lon = pings.lat[first:at], pings.lon[first:at]
    box = (lat.min(), lat.max(), lon.min(), lon.max())
    while at < total:
        more = _still_together(params, pings, at, min(at + step, total), box)
        if more:
            lat, lon = pings.lat[at:at + more], pings.lon[at:at + more]
            box = (min(box[0], lat.min()), max(box[1], lat.max()), min(box[2], lon.min()), max(box[3], lon.max()))
        at += more
        if more < step:
            break
        step *= 2
    if at < total:
        lats, lons = RunningMedian(pings.lat[first:at]), RunningMedian(pings.lon[first:at])
        while at < total:
            until = min(at + 4096, total)
            for lat, lon in zip(pings.lat[at:until].tolist(), pings.lon[at:until].tolist()):
                if dist(lat, lon, lats.value(), lons.value()) > radius:
                    return at
                lats.add(lat)
                lons.add(lon)
                at += 1
    return at


def _stops_between(pings: _Pings, begin: np.ndarray, end: np.ndarray, params: StopParams) -> Iterator[pa.RecordBatch]:
    """Stops of the complete units ``[begin, end)``."""
    kept = _able(pings, begin, end, params)
    begin, end = begin[kept], end[kept]
    if not len(begin):
        return
    together = _surely_together(params, *boxes(pings, begin, end))
    runs = [np.column_stack([begin[together], end[together]])]
    for low, high in zip(begin[~together].tolist(), end[~together].tolist()):
        runs.append(np.array(list(groups_of_unit(pings.cut(low, high), params))) + low)
    low, high = np.concatenate(runs).T
    yield from settle(pings, low, high, params)


def _able(pings: _Pings, begin: np.ndarray, end: np.ndarray, params: StopParams) -> np.ndarray:
    enough = end - begin >= params.min_size
    if params.min_stay is not None:
        enough &= pings.t[end - 1] - pings.t[begin] >= params.min_stay
    return enough


def settle(pings: _Pings, begin: np.ndarray, end: np.ndarray, params: StopParams) -> Iterator[pa.RecordBatch]:
    """The groups ``[begin, end)`` that are long and large enough, as stops."""
    kept = _able(pings, begin, end, params)
    if kept.any():
        yield _settle_compact(pings, begin[kept], end[kept], params)


def boxes(pings: _Pings, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """South, north, west and east of each stretch ``[begin, end)``, none of them empty."""
    bounds = np.column_stack([begin, end]).ravel()
    if bounds[-1] == len(pings.t):
        bounds = bounds[:-1]
    return (np.minimum.reduceat(pings.lat, bounds)[::2], np.maximum.reduceat(pings.lat, bounds)[::2],
            np.minimum.reduceat(pings.lon, bounds)[::2], np.maximum.reduceat(pings.lon, bounds)[::2])


def _sure_ends(params: StopParams, before: _Pings, after: _Pings) -> np.ndarray:
    """Where a stop must end between consecutive pings."""
    ends = _surely_apart(params, before.lat, before.lon, after.lat, after.lon)
    if params.max_gap is not None:
        ends |= after.t - before.t > params.max_gap
    return ends


def _changes(column: pa.Array, last) -> np.ndarray:
    """True at each row whose value differs from the row before it; ``last`` is the value before the first."""
    changed = np.ones(len(column), bool)
    changed[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    changed[0] = column[0].as_py() != last
    return changed


def units_of(batches: Iterator[pa.RecordBatch], keys: list[str], params: StopParams | None):
    """Units of sorted pings, batch by batch; without ``params`` only the keys cut them.

    Yields the pings, where units begin and end, and whether a sure end (rather than the
    first or last ping of a group of ``keys``) stands at either side.  A unit that goes on
    in the next batch is kept in parts until it ends.
    """
    parts: list[_Pings] = []
    opened_surely, last_keys = False, [object()] * len(keys)
    for batch in batches:
        if not batch.num_rows:
            continue
        pings = _Pings.of(batch)
        columns = [batch.column(name) for name in keys]
        group = np.zeros(len(pings.t), bool)
        for column, last in zip(columns, last_keys):
            group |= _changes(column, last)
        sure = np.zeros(len(pings.t), bool)
        if params is not None:
            sure[1:] = _sure_ends(params, pings.cut(0, len(pings.t) - 1), pings.cut(1, len(pings.t)))
        if parts and params is not None:
            sure[0] = _sure_ends(params, parts[-1].cut(len(parts[-1].t) - 1, len(parts[-1].t)), pings.cut(0, 1))[0]
        sure &= ~group
        cuts = np.flatnonzero(group | sure)
        last_keys = [column[len(column) - 1].as_py() for column in columns]
        if not len(cuts):
            parts.append(pings)
            continue
        if cuts[0] > 0:
            parts.append(pings.cut(0, int(cuts[0])))
        if parts:
            whole = _Pings.joined(parts)
            yield whole, np.array([0]), np.array([len(whole.t)]), np.array([opened_surely]), np.array([sure[cuts[0]]])
        if len(cuts) > 1:
            yield pings, cuts[:-1], cuts[1:], sure[cuts[:-1]], sure[cuts[1:]]
        parts, opened_surely = [pings.cut(int(cuts[-1]), len(pings.t))], bool(sure[cuts[-1]])
    if parts:
        whole = _Pings.joined(parts)
        yield whole, np.array([0]), np.array([len(whole.t)]), np.array([opened_surely]), np.array([False])


def search_periods(batches: Iterator[pa.RecordBatch], params: StopParams) -> Iterator[pa.RecordBatch]:
    """Pings sorted by (user, period, time) in; stops, and pings and summaries of units, out.

    Units are numbered 2 p for what lies before the first sure end of period p (all of it,
    if there is none) and 2 p + 1 for what lies after the last.
    """
    for pings, begin, end, from_sure, to_sure in units_of(batches, ["user_id", "period"], params):
        complete = from_sure & to_sure
        for stops in _stops_between(pings, begin[complete], end[complete], params):
            yield _row_kind(stops, STOP)
        if not complete.all():
            begin, end, later = begin[~complete], end[~complete], from_sure[~complete]
            unit = pings.t[begin] // params.period_seconds * 2 + later
            yield from _touching(pings, begin, end, unit, params)


def _row_kind(stops: pa.RecordBatch, kind: int, **more: pa.Array) -> pa.RecordBatch:
    given = {"kind": pa.array(np.full(stops.num_rows, kind, np.int32)), **more}
    return pa.RecordBatch.from_arrays(
        [*stops.columns, *(given.get(f.name, pa.nulls(stops.num_rows, f.type)) for f in list(SEARCH_FIELDS)[len(STOP_FIELDS):])],
        schema=SEARCH_FIELDS)


def as_rows(pings: _Pings, rows: np.ndarray) -> pa.RecordBatch:
    """Pings in the columns of stops."""
    none = pa.nulls(len(rows), pa.int64())
    return pa.RecordBatch.from_arrays([
        pings.user.take(pa.array(rows)), pa.array(pings.t[rows]), none, pa.array(pings.lat[rows]), pa.array(pings.lon[rows]),
        pa.array(pings.accuracy[rows]), none, pa.array(pings.ping[rows]), none], schema=STOP_FIELDS)


def _touching(pings: _Pings, begin, end, unit, params: StopParams) -> Iterator[pa.RecordBatch]:
    """Pings of the units ``[begin, end)`` with where their group opens, and a summary per unit."""
    together = _surely_together(params, *boxes(pings, begin, end))
    low, high, owner = begin[together], end[together], np.flatnonzero(together)
    grown = [(which, np.array(list(groups_of_unit(pings.cut(begin[which], end[which]), params))) + begin[which])
             for which in np.flatnonzero(~together)]
    low, high = (np.concatenate([some, *(runs[:, side] for _, runs in grown)]) for side, some in enumerate((low, high)))
    owner = np.concatenate([owner, *(np.full(len(runs), which) for which, runs in grown)])
    order = np.argsort(low)
    low, high, owner = low[order], high[order], owner[order]
    sizes = end - begin
    rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    yield _row_kind(
        as_rows(pings, rows), PING, unit=pa.array(np.repeat(unit, sizes)), place=pa.array(rows - np.repeat(begin, sizes)),
        opened=pa.array(np.repeat(low - begin[owner], high - low)))
    # groups are in order of units, so a unit's first and last are where the owner changes
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(owner)) - 1
    several = last > first
    second = np.minimum(first + 1, last)
    first_boxes, all_boxes = boxes(pings, low[first], high[first]), boxes(pings, begin, end)
    marks = np.column_stack([
        pings.lat[begin], pings.lon[begin], pings.lat[end - 1], pings.lon[end - 1], *first_boxes,
        np.where(several, pings.lat[low[second]], np.nan), np.where(several, pings.lon[low[second]], np.nan),
        *boxes(pings, low[last], high[last]), _reach(params, pings, low[first], high[first], first_boxes),
        *all_boxes, _reach(params, pings, begin, end, all_boxes)])
    counts = np.column_stack([last - first + 1, high[first] - low[first], low[last] - begin, high[last] - low[last]])
    yield _row_kind(
        pa.RecordBatch.from_arrays([
            pings.user.take(pa.array(begin)), pa.array(pings.t[begin]), pa.array(pings.t[end - 1]),
            *[pa.nulls(len(begin), pa.float64())] * 3, *[pa.nulls(len(begin), pa.int64())] * 3], schema=STOP_FIELDS),
        SUMMARY, unit=pa.array(unit), marks=_lists(marks, np.zeros(len(begin), np.int64), np.zeros(0)),
        counts=_lists(counts, *_histograms(
            params, pings, (low[first], high[first]), *((np.where(several, a, b), b) for a, b in ((low[last], high[last]), (begin, end))))))


def _reach(params: StopParams, pings: _Pings, low: np.ndarray, high: np.ndarray, around: tuple[np.ndarray, ...]) -> np.ndarray:
    """The largest distance of a ping of each group ``[low, high)`` from the middle of its box."""
    sizes = high - low
    starts = np.cumsum(sizes) - sizes
    rows = np.arange(sizes.sum()) + np.repeat(low - starts, sizes)
    south, north, west, east = around
    apart = _consecutive_distance(params.metric, np.repeat((south + north) / 2, sizes), np.repeat((west + east) / 2, sizes),
                                  pings.lat[rows], pings.lon[rows])
    return np.maximum.reduceat(apart, starts)


def _lists(heads: np.ndarray, sizes: np.ndarray, rest: np.ndarray) -> pa.ListArray:
    """Each row of ``heads``, followed by its ``sizes`` values of ``rest``."""
    width = heads.shape[1]
    offsets = np.concatenate([[0], np.cumsum(sizes + width)])
    values = np.empty(offsets[-1], heads.dtype)
    at_head = (offsets[:-1, None] + np.arange(width)).ravel()
    values[at_head] = heads.ravel()
    behind = np.ones(len(values), bool)
    behind[at_head] = False
    values[behind] = rest
    return pa.ListArray.from_arrays(offsets.astype(np.int32), values)


def bin_width(params: StopParams) -> float:
    """Degrees (or units) that a bin of a summary's counts covers, on either axis."""
    radius = params.radius_m if params.metric == "euclidean" else np.degrees(params.radius_m / EARTH_RADIUS_M)
    return float(radius) / BINS_PER_RADIUS


def _histograms(params: StopParams, pings: _Pings, *stretches: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many coordinates of each unit's ``stretches`` fall in each bin: (kind, bin, count) in a row.

    Returns the number of values per unit, and all of them.  Kinds 0 and 1 are latitude and longitude of the first
    stretch, 2 and 3 those of the second, and so on.  Units of one group have but the first stretch.
    """
    width, owners, bins, kinds = bin_width(params), [], [], 2 * len(stretches)
    for kind, (low, high, values) in enumerate((*bounds, values) for bounds in stretches for values in (pings.lat, pings.lon)):
        sizes = high - low
        rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        owners.append(np.repeat(np.arange(len(low)) * kinds + kind, sizes))
        bins.append(np.floor(values[rows] / width).astype(np.int64))
    owner, bin_ = np.concatenate(owners), np.concatenate(bins)
    lowest = bin_.min()
    span = bin_.max() - lowest + 1
    keys, times = np.unique(owner * span + (bin_ - lowest), return_counts=True)
    owner = keys // span
    rows = np.column_stack([owner % kinds, keys % span + lowest, times])
    return np.bincount(owner // kinds, minlength=len(stretches[0][0])) * 3, rows.ravel()
