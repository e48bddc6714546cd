"""How the units of neighbouring periods join into stops.

A stop is grown ping by ping, but from the ping that opens it on it depends on nothing
earlier.  So every unit has been searched from its own first ping on, on the guess that a
stop opens there; only the group that reaches over from the unit before can differ from
that guess, and as soon as it ends where the guess also opens a group, both agree for good.

:func:`join_units` walks along a user's summaries, one row per unit.  The median of a group
lies within known bins of its coordinates, however many pings it has, so mostly the
summaries alone tell whether the next unit's first group joins it, and whether the ping
behind that group ends it, or whether the next unit joins it as a whole.  Where they leave it open, the pings from the group's opening on
are asked for and walked, each such stretch in a task of its own, all at once
(:func:`walk_stretches`).  What a walk finds holds for the group it started from; a walk
that met no guessed opening changes the group the next stretch starts from, which is then
asked for again over a longer range.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa

from dwellpath.operators.stop_pass import (
    JUMP_MAX_LAT,
    JUMP_MAX_LON,
    JUMP_MAX_RADIUS_M,
    _changes,
    _Pings,
    _sure_ends,
    bin_width,
    boxes,
    groups_of_unit,
    settle,
    units_of,
)
from dwellpath.params import EARTH_RADIUS_M, StopParams

# What is known of a unit (a summary, or what a walk has found from it on), sorted by user, unit and kind.
UNITS = "user_id string, unit long, kind int, t_start long, t_end long, marks array<double>, counts array<long>," \
    " head_unit long, head_place long, last_unit long"
FOUND, GUESSED = 0, 1

# Rows on units, and of the plan, that are held as such at a time.
ROWS_AT_ONCE = 4096
_NONE = -(1 << 63)

# Per unit where its first group belongs, or all of it, which walk covers it, whether its first or last group goes on through whole
# units; and, with ``asked``, the units of a stretch to walk.
PLAN = pa.schema([
    ("user_id", pa.string()), ("unit", pa.int64()), ("lead_unit", pa.int64()), ("lead_place", pa.int64()), ("lead_whole", pa.bool_()),
    ("walk_unit", pa.int64()), ("walk_head_unit", pa.int64()), ("walk_head_place", pa.int64()),
    ("lead_through", pa.bool_()), ("head_through", pa.bool_()), ("through_unit", pa.int64()), ("through_place", pa.int64()),
    ("asked", pa.bool_()), ("from_place", pa.int64()),
])

Box = tuple[float, float, float, float]


class _Group:
    """An open group: where it opened, the units it has come through, and counts of its coordinates."""

    __slots__ = ("unit", "place", "size", "box", "counted", "since")

    def __init__(self, unit: int, place: int, size: int, box: Box, counted: tuple, since: int) -> None:
        self.unit, self.place, self.size, self.box = unit, place, size, box
        self.counted = counted  # a chain (earlier part, where counts of its coordinates stand); added up when first needed
        self.since = since  # index of the first row whose pings a walk from this group needs

    def joined(self, size: int, box: Box, counted: tuple) -> "_Group":
        (south, _, west, _), (_, north, _, east) = map(min, zip(self.box, box)), map(max, zip(self.box, box))
        return _Group(self.unit, self.place, self.size + size, (south, north, west, east), (self.counted, counted), self.since)

    def bins(self) -> tuple[dict, dict]:
        earlier, counted = self.counted
        if earlier is not None or not isinstance(counted[0], dict):
            total: tuple[dict, dict] = ({}, {})
            link: tuple | None = self.counted
            while link is not None:
                link, counted = link
                for mine, more in zip(total, counted if isinstance(counted[0], dict) else _bins(*counted)):
                    for b, n in more.items():
                        mine[b] = mine.get(b, 0) + n
            self.counted = (None, total)
        return self.counted[1]

    def median_box(self, more: int, box: Box | None, width: float) -> Box:
        """Where the median lies while up to ``more`` pings inside ``box`` are added.

        They move it by at most half as many ranks.
        """
        if more >= self.size:
            south, north, west, east = zip(self.box, box)
            return min(south), max(north), min(west), max(east)
        lowest, highest = max(1, -(-(self.size - more) // 2)), min(self.size, (self.size + more) // 2 + 1)
        found = []
        lats, lons = self.bins()
        for bins, low, high in ((lats, *self.box[:2]), (lons, *self.box[2:])):
            below, ordered = 0, sorted(bins)
            first = last = None
            for b in ordered:
                below += bins[b]
                if first is None and below >= lowest:
                    first = b
                if below >= highest:
                    last = b
                    break
            found += [max(low, (first - 1e-6) * width), min(high, (last + 1 + 1e-6) * width)]
        return tuple(found)


def _bins(counts: np.ndarray, kinds: tuple[int, int]) -> tuple[dict, dict]:
    found: tuple[dict, dict] = ({}, {})
    counts = counts.tolist()
    for kind, b, n in zip(counts[4::3], counts[5::3], counts[6::3]):
        if kind in kinds:
            found[kind - kinds[0]][b] = n
    return found


class _Distance:
    """Bounds on the distance between points of two boxes; undecided near the poles and the date line."""

    def __init__(self, params: StopParams) -> None:
        self.plane = params.metric == "euclidean"
        self.radius = params.radius_m
        self.sure = self.plane or self.radius <= JUMP_MAX_RADIUS_M

    def _metres(self, high: float, wide: float, one: Box, two: Box, nearest: bool) -> float:
        if self.plane:
            return float(np.hypot(high, wide))
        edges = [abs(x) for x in (*one[:2], *two[:2])]
        across = min(one[0], two[0]) <= 0 <= max(one[1], two[1])
        at = max(edges) if nearest else 0.0 if across else min(edges)
        return float(np.radians(np.hypot(high, wide * np.cos(np.radians(at)))) * EARTH_RADIUS_M)

    def _able(self, *some: Box) -> bool:
        return self.plane or self.sure and all(
            max(abs(x) for x in box[:2]) < JUMP_MAX_LAT and max(abs(x) for x in box[2:]) < JUMP_MAX_LON for box in some)

    def all_within(self, one: Box, two: Box) -> bool:
        high, wide = max(one[1] - two[0], two[1] - one[0]), max(one[3] - two[2], two[3] - one[2])
        return self._able(one, two) and self._metres(high, wide, one, two, False) <= self.radius * 0.999

    def all_reached(self, middle: Box, reach: float, two: Box) -> bool:
        """Whether all within ``reach`` of the point ``middle`` are within the radius of all points of the box ``two``."""
        high, wide = max(middle[1] - two[0], two[1] - middle[0]), max(middle[3] - two[2], two[3] - middle[2])
        return self._able(middle, two) and self._metres(high, wide, middle, two, False) + reach <= self.radius * 0.999

    def all_beyond(self, one: Box, two: Box) -> bool:
        high = max(one[0] - two[1], two[0] - one[1], 0.0)
        wide = max(one[2] - two[3], two[2] - one[3], 0.0)
        return self._able(one, two) and self._metres(high, wide, one, two, True) > self.radius * 1.001


def join_units(batches: Iterator[pa.RecordBatch], params: StopParams, reach: int) -> Iterator[pa.RecordBatch]:
    """The plan for the units of one user after another; a stretch asked for goes over ``reach`` units.

    A user's units number at most two per period.  They are read one by one; what is kept of each is
    some numbers, never its summary.
    """
    def rows() -> Iterator[dict]:
        for batch in batches:
            plain = batch.select([name for name in batch.schema.names if name not in ("marks", "counts")]).to_pylist()
            lists = []
            for name in ("marks", "counts"):
                offsets, values = batch.column(name).offsets.tolist(), batch.column(name).values.to_numpy(zero_copy_only=False)
                lists.append([values[a:b] for a, b in zip(offsets, offsets[1:])])
            for row, marks, counts in zip(plain, *lists):
                yield {**row, "marks": marks, "counts": counts}

    plan = ({"user_id": user, **row} for user, known in groupby(rows(), key=lambda row: row["user_id"])
            for row in _plan_of(known, params, reach))
    while some := list(islice(plan, ROWS_AT_ONCE)):
        yield pa.RecordBatch.from_pylist(some, schema=PLAN)


def _plan_of(known: Iterable[dict], params: StopParams, reach: int) -> Iterator[dict]:
    """The plan for one user's units, sorted by unit and kind."""
    width, distance = bin_width(params), _Distance(params)
    numbers, lead_unit, lead_place, whole = array("q"), array("q"), array("q"), bytearray()
    walks: list[tuple[int, int, int, int, int]] = []  # first and last unit covered, and the walk
    asked: list[tuple[int, int, int, int, int]] = []  # first and last unit whose pings are needed, and the walk
    through: dict[tuple[int, int], tuple[int, int]] = {}  # groups that lead several units: where they open, and the last
    led, times = None, 0  # the group that led a unit last, and how many

    def last_group(row: dict) -> _Group:
        several, _, place, size = row["counts"][:4].tolist()
        box = tuple(row["marks"][10:14].tolist())
        return _Group(row["unit"], place, size, box, (None, (row["counts"], (2, 3) if several > 1 else (0, 1))), len(numbers) - 1)

    def found_group(row: dict) -> _Group:
        unit, place, size = row["counts"][1:4].tolist()
        return _Group(unit, place, size, tuple(row["marks"].tolist()), (None, (row["counts"], (2, 3))), bisect_left(numbers, unit))

    def guess_on(group: _Group, row: dict) -> _Group:
        return last_group(row) if row["counts"][0] > 1 else group.joined(
            int(row["counts"][1]), tuple(row["marks"][4:8].tolist()), (row["counts"], (0, 1)))

    def all_join(box: Box, reached: float, medians: Box) -> bool:
        south, north, west, east = box
        middle = ((south + north) / 2,) * 2 + ((west + east) / 2,) * 2
        return distance.all_within(box, medians) or distance.all_reached(middle, reached, medians)

    def leads(group: _Group, all_of_unit: bool) -> None:
        nonlocal led, times
        at, key = len(numbers) - 1, (group.unit, group.place)
        lead_unit[at], lead_place[at], whole[at] = *key, all_of_unit
        times = times + 1 if key == led else 1
        led = key
        if times > 1:  # the group goes through whole units, so it is not gathered in one task
            through[key] = (group.since, at)

    group: _Group | None = None
    guessed = False  # whether the group comes from behind a stretch that is still to be walked
    found: dict[tuple[int, int], dict] = {}  # walks from the next unit on, by the group they started from
    covering: dict | None = None  # the walk that covers the present unit
    asking: tuple[int, int, int, int] | None = None  # the stretch that the present unit may belong to
    left = 0
    for row, opens in _with_openings(known, params):
        if row["kind"] == FOUND:
            found[row["head_unit"], row["head_place"]] = row
            continue
        numbers.append(row["unit"])
        lead_unit.append(_NONE)
        lead_place.append(_NONE)
        whole.append(False)
        at, (walks_here, found) = len(numbers) - 1, (found, {})
        if asking is not None:
            if left and not opens:
                # until the walk is known: a unit of several groups ends with its own, one of a single group is gone through
                group, left = guess_on(group, row), left - 1
                continue
            asked.append((asking[0], at - 1, *asking[1:]))
            asking = None
        if covering is None:
            if opens:
                group, guessed = last_group(row), False
                continue
            covering = walks_here.get((group.unit, group.place))
            if covering is not None:
                walks.append((at, at, row["unit"], group.unit, group.place))
        if covering is not None:
            walks[-1] = (walks[-1][0], at, *walks[-1][2:])
            if row["unit"] == covering["last_unit"]:
                group = last_group(row) if covering["counts"][0] else found_group(covering)
                covering = None
            continue
        marks = row["marks"].tolist()
        several, size, before_last, last_size = row["counts"][:4].tolist()
        several, first_box = several > 1, tuple(marks[4:8])
        lat, lon = marks[:2]
        if distance.all_beyond((lat, lat, lon, lon), group.median_box(0, None, width)):
            group = last_group(row)
            continue
        if all_join(first_box, marks[14], group.median_box(size, first_box, width)):
            merged = group.joined(size, first_box, (row["counts"], (0, 1)))
            lat, lon = marks[8:10]
            if not several or distance.all_beyond((lat, lat, lon, lon), merged.median_box(0, None, width)):
                leads(group, False)
                group = last_group(row) if several else merged
                continue
        if several:
            # alone the unit would be several groups, yet all of it may lie within reach of the group that comes in
            size, box = before_last + last_size, tuple(marks[15:19])
            if all_join(box, marks[19], group.median_box(size, box, width)):
                leads(group, True)
                group = group.joined(size, box, (row["counts"], (4, 5)))
                continue
        if guessed and at - group.since > reach:
            # a walk from so far back on a guess would be repeated for every stretch; a later round knows more
            group = guess_on(group, row)
            continue
        asking, left = (group.since, row["unit"], group.unit, group.place), reach - 1
        group, guessed = guess_on(group, row), True
    if asking is not None:
        asked.append((asking[0], len(numbers) - 1, *asking[1:]))

    through_unit, through_place = np.full((2, len(numbers)), _NONE)
    for (unit, place), (since, last) in through.items():
        through_unit[since:last], through_place[since:last] = unit, place
    walks.append((len(numbers), len(numbers), 0, 0, 0))
    this = 0
    for at, unit in enumerate(numbers):
        row = {"unit": unit, "asked": False, "lead_through": False, "head_through": False}
        if lead_unit[at] != _NONE:
            key = lead_unit[at], lead_place[at]
            row.update(lead_unit=key[0], lead_place=key[1], lead_whole=bool(whole[at]), lead_through=key in through)
        if through_unit[at] != _NONE:
            row.update(through_unit=int(through_unit[at]), through_place=int(through_place[at]))
        if at > walks[this][1]:
            this += 1
        if at >= walks[this][0]:
            _, _, walk_unit, head_unit, head_place = walks[this]
            row.update(walk_unit=walk_unit, walk_head_unit=head_unit, walk_head_place=head_place,
                       head_through=(head_unit, head_place) in through)
        yield row
    for since, last, walk_unit, head_unit, head_place in asked:
        for part in range(since, last + 1):
            yield {"unit": numbers[part], "asked": True, "walk_unit": walk_unit, "walk_head_unit": head_unit,
                   "walk_head_place": head_place, "from_place": head_place if part == since else 0}


def _with_openings(known: Iterable[dict], params: StopParams) -> Iterator[tuple[dict, bool]]:
    """Rows on units, and whether the unit surely begins with a new stop: the first, one behind a sure end, or after a gap or jump."""
    known, last = iter(known), None
    while some := list(islice(known, ROWS_AT_ONCE)):
        units = [row for row in some if row["kind"] == GUESSED]
        sure = np.array([row["unit"] % 2 == 1 for row in units], bool)
        if last is None:
            sure[:1] = True
        both = units if last is None else [last, *units]
        if len(both) > 1:
            marks = np.array([row["marks"][:4] for row in both])
            times = np.array([(row["t_start"], row["t_end"]) for row in both])
            before = _Pings(None, times[:-1, 1], None, marks[:-1, 2], marks[:-1, 3], None)
            after = _Pings(None, times[1:, 0], None, marks[1:, 0], marks[1:, 1], None)
            sure[len(units) - len(both) + 1:] |= _sure_ends(params, before, after)
        last = units[-1] if units else last
        opens = iter(sure.tolist())
        for row in some:
            yield row, row["kind"] == GUESSED and next(opens)


# What a walk yields: pings with the group they belong to, and one row on the open group behind them.
WALKED = pa.schema([
    ("user_id", pa.string()), ("epoch_time", pa.int64()), ("ping_id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()),
    ("accuracy", pa.float64()), ("kind", pa.int32()), ("unit", pa.int64()), ("place", pa.int64()), ("group_unit", pa.int64()),
    ("group_place", pa.int64()), ("walk_unit", pa.int64()), ("walk_head_unit", pa.int64()), ("walk_head_place", pa.int64()),
    ("last_unit", pa.int64()), ("marks", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64())),
])


def walk_stretches(batches: Iterator[pa.RecordBatch], params: StopParams) -> Iterator[pa.RecordBatch]:
    """Walk stretches of pings, sorted by user, stretch, unit and place, until a group opens where it was guessed."""
    keys = ["user_id", "walk_unit", "walk_head_unit", "walk_head_place"]
    for batch, begin, end in _whole(batches, keys):
        for low, high in zip(begin, end):
            yield from _walk(batch.slice(low, high - low), params)


def _walk(stretch: pa.RecordBatch, params: StopParams) -> Iterator[pa.RecordBatch]:
    pings = _Pings.of(stretch)
    unit, place, opened = (stretch.column(name).to_numpy() for name in ("unit", "place", "opened"))
    first_unit = stretch.column("walk_unit")[0].as_py()
    until, total = len(unit), len(unit)
    starts, merged = [0], False
    for low, high in groups_of_unit(pings, params):
        if high < total and unit[high] >= first_unit and place[high] == opened[high]:
            until, merged = high, True
            break
        starts.append(high)
    bounds = np.array([s for s in starts if s < until] + [until])
    group = np.repeat(bounds[:-1], np.diff(bounds))
    group_unit, group_place = unit[group], place[group]
    last_unit = unit[until] if merged else unit[-1]
    rest = np.arange(until, int(np.searchsorted(unit, last_unit, "right")))
    group_unit, group_place = np.append(group_unit, unit[rest]), np.append(group_place, opened[rest])
    shown = np.arange(int(np.searchsorted(unit, first_unit)), len(group_unit))
    walk = {name: stretch.column(name)[0].as_py() for name in ("walk_unit", "walk_head_unit", "walk_head_place")}

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        columns.update({name: pa.array(np.full(size, value)) for name, value in walk.items()})
        columns["last_unit"] = pa.array(np.full(size, last_unit))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in WALKED], schema=WALKED)

    yield rows(len(shown), kind=pa.array(np.zeros(len(shown), np.int32)), unit=pa.array(unit[shown]), place=pa.array(place[shown]),
               group_unit=pa.array(group_unit[shown]), group_place=pa.array(group_place[shown]),
               user_id=pings.user.take(pa.array(shown)), epoch_time=pa.array(pings.t[shown]), ping_id=pa.array(pings.ping[shown]),
               lat=pa.array(pings.lat[shown]), lon=pa.array(pings.lon[shown]), accuracy=pa.array(pings.accuracy[shown]))
    # counts: whether the guess holds from here on, else the group that is open at the end
    marks, counts = [], [1, 0, 0, 0]
    if not merged:
        low = bounds[-2]
        marks = [float(edge[0]) for edge in boxes(pings, np.array([low]), np.array([total]))]
        counts = [0, int(unit[low]), int(place[low]), total - int(low)]
        for kind, values in ((2, pings.lat), (3, pings.lon)):
            bins, times = np.unique(np.floor(values[low:] / bin_width(params)).astype(np.int64), return_counts=True)
            counts += np.column_stack([np.full(len(bins), kind), bins, times]).ravel().tolist()
    yield rows(1, kind=pa.array([1], pa.int32()), user_id=pings.user.slice(0, 1),
               marks=pa.array([marks], pa.list_(pa.float64())), counts=pa.array([counts], pa.list_(pa.int64())))


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Sorted rows with where each run of equal ``keys`` begins and ends; no run is cut."""
    held: list[pa.RecordBatch] = []
    last = [object()] * len(keys)
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for at, name in enumerate(keys):
            new |= _changes(batch.column(name), last[at])
        last = [batch.column(name)[batch.num_rows - 1].as_py() for name in keys]
        cuts = np.flatnonzero(new)
        if not len(cuts):
            held.append(batch)
            continue
        if held or cuts[0] > 0:
            whole = _joined([*held, batch.slice(0, int(cuts[0]))])
            yield whole, np.array([0]), np.array([whole.num_rows])
        if len(cuts) > 1:
            yield batch, cuts[:-1], cuts[1:]
        held = [batch.slice(int(cuts[-1]))]
    if held:
        whole = _joined(held)
        yield whole, np.array([0]), np.array([whole.num_rows])


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def settle_groups(batches: Iterator[pa.RecordBatch], params: StopParams) -> Iterator[pa.RecordBatch]:
    """Stops of groups of pings, sorted by user, group and time."""
    for pings, begin, end, _, _ in units_of(batches, ["user_id", "group_unit", "group_place"], None):
        yield from settle(pings, begin, end, params)
