"""Sessions, stop detection and its hand cases."""

from __future__ import annotations

import math
import statistics
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import dwellpath as dp
from dwellpath import session
from dwellpath.operators import stop_chains, stop_pass, stops
from dwellpath.operators.stop_pass import RunningMedian, _Pings, groups_of_unit, settle

PING = "user_id string, ping_id long, epoch_time long, lat double, lon double, accuracy double"
METRE = math.degrees(1 / 6_371_000.0)


def pings_of(spark, rows):
    return spark.createDataFrame(rows, PING)


def stops_of(spark, rows, **kw):
    found = dp.detect_stops(pings_of(spark, rows), dp.StopParams(**kw)).collect()
    return sorted(tuple(row) for row in found)


def at_spot(times, accuracies=None, lat=10.0, lon=20.0, user="u"):
    return [(user, i, t, lat, lon, float(accuracies[i]) if accuracies else 10.0) for i, t in enumerate(times)]


def metres(a, b):
    chord = (math.sin(math.radians(b[0] - a[0]) / 2) ** 2
             + math.sin(math.radians(b[1] - a[1]) / 2) ** 2 * math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])))
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(chord)))


def plain_stops(rows, p):
    """The rules, ping by ping, with library medians."""
    out = []
    by_user = {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        by_user.setdefault(row[0], []).append(row)

    def close(group):
        if len(group) >= p.min_size and (p.min_stay is None or group[-1][2] - group[0][2] >= p.min_stay):
            used = group if p.accuracy_includes_last else group[:-1]
            out.append((group[0][0], group[0][2], group[-1][2], statistics.median(r[3] for r in group),
                        statistics.median(r[4] for r in group),
                        statistics.median(r[5] for r in used) if used else None, len(group)))

    for rows in by_user.values():
        group = [rows[0]]
        for before, row in zip(rows, rows[1:]):
            centre = (statistics.median(r[3] for r in group), statistics.median(r[4] for r in group))
            apart = metres((row[3], row[4]), centre) if p.metric == "haversine" else math.dist((row[3], row[4]), centre)
            if apart <= p.radius_m and (p.max_gap is None or row[2] - before[2] <= p.max_gap):
                group.append(row)
            else:
                close(group)
                group = [row]
        close(group)
    return sorted(out)


def wandering(seed, users=6, n=400, step=18.0):
    """Users that linger, drift, jump and fall silent."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        lat, lon, t = 40.0 + u, -70.0 + u, 1_600_000_000
        for i in range(n):
            t += int(rng.choice([0, 1, 60, 200, 900, 3600, 3601, 9000], p=[.05, .1, .3, .3, .1, .05, .05, .05]))
            if rng.random() < 0.06:
                lat += rng.normal() * 120 * METRE
            drift = step if u % 2 else step / 3
            lat, lon = lat + rng.normal() * drift * METRE * 0.5, lon + rng.normal() * drift * METRE * 0.5
            shown = (lat + rng.normal() * drift * METRE, lon + rng.normal() * drift * METRE)
            if u == 2:  # coordinates that repeat
                shown = (round(shown[0], 4), round(shown[1], 4))
            rows.append((f"u{u}", i, t, *map(float, shown), float(rng.integers(5, 300))))
    return rows


def same(got, want):
    assert [row[:3] + row[6:] for row in got] == [row[:3] + row[6:] for row in want]
    for a, b in zip(got, want):
        assert a[3:6] == pytest.approx(b[3:6], abs=1e-9)


@given(st.lists(st.integers(-5, 5).map(float) | st.floats(-1, 1), min_size=1, max_size=60))
def test_running_median_follows_every_prefix(values):
    for known in {1, (len(values) + 1) // 2}:
        median = RunningMedian(np.array(values[:known]))
        assert median.value() == pytest.approx(statistics.median(values[:known]), abs=1e-12)
        for n, value in enumerate(values[known:], known + 1):
            median.add(value)
            assert median.value() == pytest.approx(statistics.median(values[:n]), abs=1e-12)


@pytest.mark.parametrize("params", [
    dp.StopParams(), dp.StopParams.untimed(), dp.StopParams(accuracy_includes_last=True, min_size=3, radius_m=25),
    dp.StopParams(metric="euclidean", radius_m=0.0004), dp.StopParams(min_size=1, min_stay=0),
])
@pytest.mark.parametrize("period", [86_400, 1_800])
def test_matches_the_rules_for_any_period_and_batch_size(spark, params, period):
    rows = wandering(7)
    want = plain_stops(rows, params)
    assert len(want) > 50
    params = dp.StopParams(**{**params.__dict__, "period_seconds": period})
    same(sorted(tuple(r) for r in dp.detect_stops(pings_of(spark, rows), params).collect()), want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        shuffled = pings_of(spark, rows).repartition(5, F.rand(3))
        same(sorted(tuple(r) for r in dp.detect_stops(shuffled, params).collect()), want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_still_device_beside_wandering_ones(spark):
    rows = wandering(11, users=2, n=1500) + at_spot(range(1_600_000_000, 1_600_600_000, 300), user="still")
    same(stops_of(spark, rows), plain_stops(rows, dp.StopParams()))


def test_a_long_noisy_dwell_takes_time_in_proportion():
    rng = np.random.default_rng(1)
    seconds = []
    for n in (100_000, 400_000):
        noise = rng.normal(0, 9 * METRE, (2, n))
        pings = _Pings(pa.array(["u"] * n), np.arange(n), np.arange(n), 10 + noise[0], 20 + noise[1], np.ones(n))
        started = time.process_time()
        assert sum(b - a for a, b in groups_of_unit(pings, dp.StopParams())) == n
        seconds.append(time.process_time() - started)
    assert seconds[1] < 8 * seconds[0]


@pytest.mark.parametrize("metric", ["haversine", "euclidean"])
def test_short_runs_are_grown_on_plain_numbers(monkeypatch, metric):
    """A noisy track, most runs of which end after a few pings, is cut as by library medians, without a slice per run."""
    slices = []
    monkeypatch.setattr(stop_pass, "_still_together", lambda *a: slices.append(a))
    rng = np.random.default_rng(3)
    unit = METRE if metric == "haversine" else 1.0
    lat, lon = 10 + rng.normal(0, 30 * unit, 600), 20 + rng.normal(0, 30 * unit, 600)
    params = dp.StopParams(metric=metric)
    want, first = [], 0
    for at in range(1, 601):
        middle = statistics.median(lat[first:at]), statistics.median(lon[first:at])
        if at == 600 or (metres(middle, (lat[at], lon[at])) if metric == "haversine" else math.dist(middle, (lat[at], lon[at]))) > 50:
            want.append((first, at))
            first = at
    pings = _Pings(pa.array(["u"] * 600), np.arange(600), np.arange(600), lat, lon, np.ones(600))
    assert list(groups_of_unit(pings, params)) == want and len(want) > 60 and not slices


def test_every_ping_is_labelled_with_its_stop(spark):
    rows = wandering(5, users=4) + [("same", i, 1_600_000_000 + i // 3 * 200, 10 + i // 9 * 200 * METRE, 20.0, 1.0) for i in range(60)]
    stops = sorted(tuple(r) for r in dp.detect_stops(pings_of(spark, rows)).collect())
    got = {(r.user_id, r.ping_id): r.stop for r in dp.label_pings(pings_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    counted = {}
    for (user, _), stop in got.items():
        if stop >= 0:
            counted[user, stop] = counted.get((user, stop), 0) + 1
    numbered, want = {}, {}
    for user, *_, size in stops:
        numbered[user] = numbered.get(user, -1) + 1
        want[user, numbered[user]] = size
    assert counted == want


def test_no_stop_from_one_ping_or_none(spark):
    assert stops_of(spark, at_spot([0])) == []
    empty = dp.detect_stops(pings_of(spark, []))
    assert empty.columns == dp.detect_stops(pings_of(spark, at_spot([0]))).columns
    assert empty.collect() == []


def test_stay_and_gap_limits(spark):
    assert stops_of(spark, at_spot([0, 299])) == []
    assert [s[1:3] for s in stops_of(spark, at_spot([0, 300]))] == [(0, 300)]
    assert [s[1:3] for s in stops_of(spark, at_spot([0, 300, 3900, 4200]))] == [(0, 4200)]
    assert [s[1:3] for s in stops_of(spark, at_spot([0, 300, 3901, 4201]))] == [(0, 300), (3901, 4201)]


def test_drift_is_measured_against_the_median(spark):
    rows = [("u", i, i * 300, 10.0 + i * 30 * METRE, 20.0, 10.0) for i in range(8)]
    assert len(stops_of(spark, rows)) > 1


def test_even_group_and_accuracy_without_the_last_ping(spark):
    rows = [("u", 0, 0, 10.0, 20.0, 10.0), ("u", 1, 300, 10.0 + 10 * METRE, 20.0, 500.0)]
    (stop,) = stops_of(spark, rows)
    assert stop[3] == pytest.approx(10.0 + 5 * METRE)
    assert stop[5] == 10.0
    assert stops_of(spark, rows, accuracy_includes_last=True)[0][5] == 255.0


def test_accuracy_limit_is_strict(spark):
    found = dp.detect_stops(pings_of(spark, at_spot([0, 300, 600], [200, 200, 1])))
    assert dp.drop_inaccurate(found).count() == 0
    assert dp.drop_inaccurate(found, 200.5).count() == 1


def test_equal_times_are_ordered_by_ping(spark):
    rows = [("u", 1, 0, 10.0, 20.0, 7.0), ("u", 0, 0, 10.0, 20.0, 5.0), ("u", 2, 300, 10.0, 20.0, 9.0)]
    (stop,) = stops_of(spark, rows)
    assert stop[5] == 6.0 and stop[6] == 3


def test_across_the_antimeridian_no_ping_is_lost(spark):
    rows = [("u", i, i * 300, 0.0, 179.9999 if i % 2 else -179.9999, 10.0) for i in range(9)]
    params = dp.StopParams()
    same(stops_of(spark, rows), plain_stops(rows, params))


def test_sessions_split_at_gaps_only(spark):
    times = [0, 3600, 7201, 7202, 20_000, 23_600]
    got = dp.sessionise(pings_of(spark, at_spot(times))).orderBy("epoch_time").collect()
    assert [row.session_id for row in got] == [0, 0, 1, 1, 2, 2]


def test_invalid_coordinates(spark):
    rows = [("u", 0, 0, 90.0, 0.0, 1.0), ("u", 1, 300, 10.0, float("nan"), 1.0), ("u", 2, 300, 10.0, 0.0, 1.0),
            ("u", 3, 900, None, 0.0, 1.0)]
    pings = pings_of(spark, rows)
    report = {row.rule: row.violations for row in dp.validation_report(pings).collect()}
    assert report == {"lat_range": 2, "lon_range": 1, "time_order": 1, "user_known": 0, "time_known": 0}
    assert dp.validate_pings(pings, "drop").count() == 1
    with pytest.raises(Exception, match="invalid ping: u"):
        dp.detect_stops(pings).collect()
    with pytest.raises(Exception, match="invalid ping: null, 5"):
        dp.detect_stops(pings_of(spark, [(None, 0, 5, 1.0, 1.0, 1.0)])).collect()
    with pytest.raises(ValueError):
        dp.validate_pings(pings, "other")


def test_a_failing_check_survives_column_pruning(spark):
    bad = pings_of(spark, at_spot([0, 60], lat=95.0)).withColumn("country", F.lit("BR"))
    with pytest.raises(Exception, match="invalid ping"):
        dp.hourly_share(dp.validate_pings(bad)).collect()
    with pytest.raises(Exception, match="invalid ping"):
        dp.sessionise(dp.validate_pings(bad)).select("user_id").collect()


def test_sessions_keep_every_ping(spark):
    rows = [(None, 0, 0, 1.0, 1.0, 1.0), (None, 1, 9000, 1.0, 1.0, 1.0), ("u", 2, None, 1.0, 1.0, 1.0), ("u", 3, 5, 1.0, 1.0, 1.0)]
    got = {r.ping_id: r.session_id for r in dp.sessionise(pings_of(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: None, 3: 0}
    report = {row.rule: row.violations for row in dp.validation_report(pings_of(spark, rows)).collect()}
    assert report["user_known"] == 2 and report["time_known"] == 1 and report["time_order"] == 0


def test_no_user_is_sent_to_one_task(spark):
    plan = dp.detect_stops(pings_of(spark, at_spot([0, 300])))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and "group_unit" in plan


def one_device(kind, n=6000, seed=3):
    """Pings every 20 seconds without a pause or a jump that would surely end a stop."""
    rng = np.random.default_rng(seed)
    lat, lon = rng.normal(0, 8, n), rng.normal(0, 8, n)
    if kind == "wandering":
        lat, lon = lat + np.cumsum(rng.normal(0, 1.5, n)), lon + np.cumsum(rng.normal(0, 1.5, n))
    if kind == "two places":
        lat = lat + np.arange(n) // 900 % 2 * 60
    if kind == "at the limit":  # some pings lie about a radius away, so summaries leave much open
        lat = np.where(rng.random(n) < 0.02, rng.uniform(44, 56, n), lat)
    if kind == "drift":
        lat = lat + np.arange(n) * 0.05
    return [("u", i, 1_600_000_000 + 20 * i, float(10 + a * METRE), float(20 + b * METRE), float(i % 70))
            for i, (a, b) in enumerate(zip(lat, lon))]


@pytest.mark.parametrize("kind", ["still", "wandering", "two places", "at the limit", "drift"])
@pytest.mark.parametrize("untimed", [False, True])
def test_a_stretch_without_a_sure_end_is_joined_from_many_units(spark, kind, untimed):
    rows = one_device(kind)
    timed = {} if not untimed else {"min_stay": None, "max_gap": None}
    params = dp.StopParams(period_seconds=3600, **timed)
    t, ping = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    pings = _Pings(pa.array(["u"] * len(rows)), t, ping, *(np.array([r[k] for r in rows]) for k in (3, 4, 5)))
    runs = np.array(list(groups_of_unit(pings, params)))
    want = sorted(tuple(row.values())[:7] for part in settle(pings, runs[:, 0], runs[:, 1], params) for row in part.to_pylist())
    got = sorted(tuple(r) for r in dp.detect_stops(pings_of(spark, rows), params).collect())
    assert got == want
    assert kind != "still" or len(got) == 1


def test_units_are_joined_by_summaries_and_few_are_walked(spark, monkeypatch):
    """A device that stays for days is one stop, none of its pings is gathered, and only its second day is walked again."""
    seen, measured = [], []
    plain, plain_groups = stops._measured, stops._with_groups
    monkeypatch.setattr(stops, "_with_groups", lambda touching, plan, walked: (
        seen.append(0 if walked is None else walked.where("kind = 0").count()), plain_groups(touching, plan, walked))[1])
    monkeypatch.setattr(stops, "_measured", lambda pings, *a: (measured.append(pings.count()), plain(pings, *a))[1])
    rows = one_device("still", n=20_000)
    (stop,) = stops_of(spark, rows)
    assert stop[6] == 20_000 and measured == [20_000] and seen[0] <= 4320
    assert stop[3:6] == (statistics.median(r[3] for r in rows), statistics.median(r[4] for r in rows),
                         statistics.median(r[5] for r in rows[:-1]))


def test_a_walk_that_misses_a_guess_reaches_further(spark):
    """Units that never agree with their guesses take several rounds, and still give the rules' stops."""
    rows = [("u", i, i * 100, 10.0 + i * 9 * METRE, 20.0, 10.0) for i in range(400)]
    for period in (700, 1900, 7000):
        params = dp.StopParams(period_seconds=period, min_stay=0)
        same(sorted(tuple(r) for r in dp.detect_stops(pings_of(spark, rows), params).collect()), plain_stops(rows, params))


def test_more_pings_are_dealt_over_more_tasks(spark, monkeypatch):
    """A task's pings and summaries stay few, however few partitions the session sets."""
    tasks = []
    plain = stops.dealt_by
    monkeypatch.setattr(stops, "dealt_by", lambda df, *a: (dealt := plain(df, *a), tasks.append(dealt.rdd.getNumPartitions()))[0])
    rows = wandering(17, users=6)
    want = stops_of(spark, rows)
    usual = max(tasks)
    monkeypatch.setattr(stops, "PINGS_PER_TASK", 50)
    monkeypatch.setattr(stops, "UNITS_PER_TASK", 2)
    tasks.clear()
    assert stops_of(spark, rows) == want
    assert tasks[0] == -(-len(rows) // 50) > usual and tasks[1] > 1


def test_a_plan_of_many_units_is_not_sent_to_every_task(spark, monkeypatch):
    """The plan is mostly empty columns, so its files stay small when its rows are many."""
    rows = [(f"u{u}", 2 * u + k, 1_600_000_000 + 600 * k, 10.0, 20.0, 5.0) for u in range(150) for k in range(2)]
    monkeypatch.setattr(session, "BROADCAST_ROWS", 100, raising=False)
    found = dp.detect_stops(pings_of(spark, rows))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.user_id, r.total_pings_stop) for r in found.collect()) == sorted((f"u{u}", 2) for u in range(150))


def test_walks_asked_for_at_once_grow_with_the_units():
    """One undecided stop through all units: a round asks for a few walks, not for one from the opening to every unit."""
    n = 7200
    at = np.arange(n)
    # mostly at one corner, at times 140 m north or east of it: all one stop, but a unit's box does not tell
    lat, lon = 10 + (at % 6 == 3) * 140 * METRE, 20 + (at % 6 == 5) * 140 * METRE
    t = 1_699_999_200 + at * 100
    params = dp.StopParams(period_seconds=3600, radius_m=150)
    batch = pa.RecordBatch.from_pydict({
        "user_id": ["u"] * n, "period": t // 3600, "ping_id": at, "epoch_time": t, "lat": lat, "lon": lon, "accuracy": np.ones(n)})
    found = [row for part in stop_pass.search_periods(iter([batch]), params) for row in part.to_pylist()]
    units = sorted(({**row, "kind": stop_chains.GUESSED, "marks": np.array(row["marks"]), "counts": np.array(row["counts"])}
                    for row in found if row["kind"] == stop_pass.SUMMARY), key=lambda row: row["unit"])
    plan = stop_chains._plan_of(units, params, 1)
    assert len(units) == 200 and 0 < sum(row["asked"] for row in plan) <= 4 * len(units)


def test_coordinates_in_exact_steps(spark):
    with pytest.raises(ValueError, match="power of two"):
        dp.StopParams(coordinate_step=1e-7)
    step = 2.0 ** -24
    rows = wandering(13, users=2)
    params = dp.StopParams(coordinate_step=step)
    snapped = [(*r[:3], round(r[3] / step) * step, round(r[4] / step) * step, r[5]) for r in rows]
    got = sorted(tuple(r) for r in dp.detect_stops(pings_of(spark, rows), params).collect())
    assert got == plain_stops(snapped, dp.StopParams())
    assert all((2 * row[3] / step).is_integer() for row in got)


def test_labels_of_a_user_with_many_stops_in_a_period(spark):
    """Untimed: thousands of stops a day, pings that share a second, a stop over several periods, a stop of one ping."""
    rng = np.random.default_rng(8)
    rows = [("u", i, 1_600_000_000 + i // 2, 10.0 + float(i // 3 % 7) * 300 * METRE, 20.0, 1.0) for i in range(3000)]
    rows += [("v", i, 1_600_000_000 + i * 7000, 10.0, 20.0, 1.0) for i in range(60)]
    rows += [("w", int(i), 5, float(rng.random()), 20.0, 1.0) for i in range(5)]
    params = dp.StopParams.untimed()
    got = {(r.user_id, r.ping_id): r.stop for r in dp.label_pings(pings_of(spark, rows), params).collect()}
    assert [got["u", i] for i in range(3000)] == [i // 3 for i in range(3000)]
    assert {got["v", i] for i in range(60)} == {0}
    assert {got["w", i] for i in range(5)} == {-1}


def restless(n: int) -> list[tuple]:
    """One device mostly at one spot, at times 85 m south or north of it: one stop, though an hour that begins there is several."""
    places = [1, 1, 0, 2, 1, 1, 2, 0]
    return [("u", i, 1_699_999_200 + i * 100, 10.0 + (places[i // 12 % 8] * 85 + i % 7 * 0.1) * METRE, 20.0, 5.0 + i % 3) for i in range(n)]


def test_a_unit_of_several_groups_may_join_as_a_whole(spark, monkeypatch):
    """A unit that is several groups by itself joins a group whose median is near all of it, without a walk from the opening."""
    walked = []
    plain = stops._with_groups
    monkeypatch.setattr(stops, "_with_groups", lambda touching, plan, found: (
        walked.append(0 if found is None else found.where("kind = 0").count()), plain(touching, plan, found))[1])
    rows = restless(3_000)
    params = dp.StopParams(period_seconds=3600, radius_m=150)
    same(sorted(tuple(r) for r in dp.detect_stops(pings_of(spark, rows), params).collect()), plain_stops(rows, params))
    assert walked[0] < 100


def test_a_plan_holds_few_summaries_at_a_time(monkeypatch):
    """Summaries of a user's units are let go once the group that is open has taken their counts."""
    import gc
    import weakref
    monkeypatch.setattr(stop_chains, "ROWS_AT_ONCE", 8, raising=False)
    params, most = dp.StopParams(period_seconds=3600), [0]
    held: weakref.WeakValueDictionary = weakref.WeakValueDictionary()

    def units():
        for unit in range(2000):
            box = np.array([10.0, 20.0, 10.0, 20.0, 10.0, 10.0, 20.0, 20.0, np.nan, np.nan, 10.0, 10.0, 20.0, 20.0, 0.0, 10.0, 10.0, 20.0, 20.0, 0.0])
            counts = np.array([1, 36, 0, 36, 0, 71160, 36, 1, 142320, 36])
            held[unit] = counts
            if unit % 100 == 0:
                gc.collect()
            most[0] = max(most[0], len(held))
            yield {"unit": 2 * unit, "kind": stop_chains.GUESSED, "t_start": 3600 * unit, "t_end": 3600 * unit + 3500, "marks": box,
                   "counts": counts, "head_unit": None, "head_place": None, "last_unit": None}

    assert sum(1 for row in stop_chains._plan_of(units(), params, 1) if not row["asked"]) == 2000
    assert most[0] < 200
