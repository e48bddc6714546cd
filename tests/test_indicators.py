"""Budgets, admin units, indicators and migration: hand cases."""

from __future__ import annotations

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

import dwellpath as dp
from dwellpath import session
from dwellpath.plans import pipelines

BINS, LABELS = [0.0, 0.4, 0.8, 1.0], ["high", "medium", "low"]
DAY = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def pieces(spark, rows):
    """(user, day, hour, type, seconds[, geom])."""
    full = [(u, dt.datetime(2024, 1, 1, h) + dt.timedelta(days=d), day(d), t, s, *(g or ["g0"]))
            for u, d, h, t, s, *g in rows]
    return spark.createDataFrame(
        full, "user_id string, date timestamp, date_trunc date, location_type string, duration long, geom_id string")


def test_budget_shares_add_up_per_user_day(spark):
    got = dp.time_budgets(pieces(spark, [("u", 0, 5, "H", 10), ("u", 0, 22, "W", 30), ("u", 0, 23, "O", 40),
                                         ("u", 0, 4, "H", 20), ("u", 1, 4, "H", 0)])).collect()
    by = {(r.date_trunc, r.day_night): r for r in got}
    assert by[DAY, "day"].H == 0.1 and by[DAY, "day"].W == 0.3 and by[DAY, "day"].O is None
    assert by[DAY, "night"].absolute_O == 40 and by[DAY, "night"].W is None
    assert sum(x or 0 for r in got if r.date_trunc == DAY for x in (r.H, r.W, r.O)) == pytest.approx(1)
    assert by[day(1), "night"].H is None and (day(1), "day") not in by


def test_activity_thresholds(spark):
    rows = [("both", d) for d in range(10)] + [("pre", d) for d in range(5)] + [("late", d) for d in range(5, 10)]
    days = spark.createDataFrame([(u, day(d)) for u, d in rows], "user_id string, date_trunc date")
    params = dp.ActivityParams(level=0.5, split="2024-01-06", end="2024-01-11")
    got = {r.user_id: (r.pre, r.post, r.tot) for r in dp.active_users(days, params).collect()}
    assert got == {"both": (5, 5, 10), "pre": (5, 0, 5)}
    late = dp.ActivityParams(level=0.0, start="2024-01-06", split="2024-01-06", end="2024-01-08")
    assert {r.user_id: r.tot for r in dp.active_users(days, late).collect()} == {"both": 2, "late": 2}
    assert dp.ActivityParams.for_country("ID").start == "2020-02-01" and dp.ActivityParams.for_country("BR").start is None


def test_commuters_and_recluses(spark):
    budgets = dp.time_budgets(pieces(spark, [("home", 0, 6, "H", 10), ("home", 0, 23, "H", 10), ("both", 0, 6, "H", 10),
                                             ("both", 0, 10, "W", 10), ("out", 0, 9, "O", 5)]))
    got = {r.user_id: (r.R, r.C) for r in dp.daily_metrics(budgets, dp.ActivityParams(end="2025-01-01")).collect()}
    assert got == {"home": (1, 0), "both": (0, 1), "out": (0, 0)}


def test_modal_unit_counts_days_and_breaks_ties(spark):
    rows = [("u", 0, h, "H", 1, "g9") for h in range(5)] + [("u", 1, 1, "H", 1, "g2"), ("u", 2, 1, "H", 1, "g2"),
            ("v", 0, 1, "H", 1, "g5"), ("v", 1, 1, "H", 1, "g4"), ("v", 5, 1, "H", 1, "g4")]
    got = {r.user_id: r.g for r in dp.modal_admin_unit(pieces(spark, rows), "H", "g", until="2024-01-02").collect()}
    assert got == {"u": "g2", "v": "g4"}


@pytest.fixture(scope="module")
def admins(spark):
    return spark.createDataFrame(
        [("A", "a1", "X", 40.0, 9.0), ("A", "a2", "X", 40.0, 8.0), ("A", "a3", None, 20.0, 7.0), ("A", "a4", "Y", 70.0, None),
         ("B", "b1", "Z", 10.0, 1.0)],
        "country string, geom_id string, metro_area_name string, pop double, wealth_index double")


def test_wealth_percentiles_bins_and_metros(spark, admins):
    got = {r.geom_id: (round(r.pct_wealth, 6), r.wealth_label)
           for r in dp.with_wealth_label(dp.wealth_percentile(admins), BINS, LABELS).collect()}
    assert got == {"a1": (0.4, "high"), "a2": (0.8, "medium"), "a3": (1.0, "low"), "b1": (1.0, "low")}
    metro = {r.geom_id: (r.pct_wealth, r.wealth_label) for r in dp.metro_units(admins, BINS, LABELS).collect()}
    assert metro == {"a1": (0.5, "medium"), "a2": (1.0, "low"), "b1": (1.0, "low")}
    assert {r.geom_id: r.urban_rural for r in dp.urban_rural(admins).collect()}["a3"] == "rural"
    assert {(r.country, r.metro_area_name): r["pop"] for r in dp.metro_population(admins).collect()} == {
        ("A", "X"): 80.0, ("B", "Z"): 10.0}
    edge = spark.createDataFrame([(0.0,), (1.1,), (None,)], "pct_wealth double")
    assert [r.wealth_label for r in dp.with_wealth_label(edge, BINS, LABELS).collect()] == [None] * 3
    with pytest.raises(ValueError):
        dp.with_wealth_label(edge, [0, 1], LABELS)


def test_weights_and_weighted_mean(spark, admins):
    metrics = spark.createDataFrame(
        [("u", DAY, 0.5, "a1", "a2"), ("v", DAY, None, "a1", None), ("w", DAY, 1.0, "a2", "a1"), ("x", DAY, 1.0, None, None),
         ("u", day(1), 1.0, "a1", "a2")], "user_id string, date date, H double, geom_id_home string, geom_id_work string")
    weighted = dp.weight_by_home(metrics, dp.wealth_percentile(admins), BINS, LABELS)
    assert {(r.user_id, r.weight) for r in weighted.collect()} == {("u", 20.0), ("v", 20.0), ("w", 40.0)}
    got = {(r.date, r.wealth_label_home): r for r in dp.indicator(weighted, "H").collect()}
    first = got[DAY, "high"]
    assert first.mean == 0.25 and first.n == 2 and first.n_unique == 2
    assert first.sem == pytest.approx(math.sqrt(0.125) / math.sqrt(2))
    assert got[DAY, "medium"].mean == 1.0 and got[DAY, "medium"].sem is None
    both = dp.weight_by_home_and_work(metrics, dp.wealth_percentile(admins), BINS, LABELS)
    assert {(r.user_id, r.weight, r.wealth_label_work) for r in both.collect()} == {
        ("u", 40.0, "medium"), ("w", 40.0, "high")}


@pytest.mark.parametrize("rows, copied", [(10, False), (1000, True)])
def test_metrics_of_many_rows_are_not_copied_to_the_driver(spark, admins, monkeypatch, rows, copied):
    """Their files are small, so each of the joins with units would otherwise send all of them to every task."""
    plans = []
    for name in ("weight_by_home", "weight_by_home_and_work"):
        plain = getattr(pipelines, name)
        monkeypatch.setattr(pipelines, name, lambda metrics, *a, plain=plain: (
            plans.append(metrics.join(dp.wealth_percentile(admins), metrics.geom_id_home == admins.geom_id)), plain(metrics, *a))[1])
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows, raising=False)
    labelled = pieces(spark, [(f"u{u}", d, 12, t, 3600, "a1") for u in range(20) for d in range(3) for t in "HW"])
    found = dp.indicators_of(labelled, admins, BINS, LABELS, "A", dp.ActivityParams(split="2024-06-01", end="2025-01-01"))
    assert {r.n for r in found.collect()} == {20}
    assert [("BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString()) for p in plans] == [copied] * 2


def series(spark, rows):
    return spark.createDataFrame(rows, "date date, g string, mean double, sem double")


def test_change_against_weekdays(spark):
    rows = [(day(0), "a", 2.0, 0.5), (day(7), "a", 4.0, 0.5), (day(14), "a", 6.0, 0.6), (day(1), "a", 0.0, 0.1),
            (day(8), "a", 5.0, 0.1), (day(2), None, 4.0, 1.0), (day(16), None, 2.0, 1.0), (day(3), "a", 1.0, 1.0)]
    got = {r.date: r for r in dp.change_from_baseline(series(spark, rows), "2024-01-01", "2024-01-10", ["g"]).collect()}
    assert got[day(14)].mean == 1.0 and got[day(14)].sem == pytest.approx(0.2)
    assert got[day(16)].mean == -0.5  # null groups match
    zero = dp.change_from_baseline(series(spark, [(day(0), "a", 0.0, 1.0)]), "2024-01-01", "2024-01-07", ["g"]).first()
    missing = dp.change_from_baseline(series(spark, [(day(0), "a", 1.0, 1.0)]), "2025-01-01", "2025-01-07", ["g"]).first()
    assert zero.mean is None and zero.sem is None and missing.mean is None
    shared = dp.change_from_baseline(series(spark, [(day(0), "a", 1.0, 1.0), (day(0), "b", 3.0, 1.0)]),
                                     "2024-01-01", "2024-01-07")
    assert sorted(r.mean for r in shared.collect()) == [-0.5, 0.5]
    diff = dp.difference_from_baseline(series(spark, rows).withColumnRenamed("mean", "m"), "m", "2024-01-01",
                                       "2024-01-10", ["g"])
    assert {r.date: r.mean for r in diff.collect()}[day(14)] == 3.0


def wide(spark, values):
    rows = [("m", "s", day(i), v, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric string, state string, date date, high double, high_StdErr double")


@pytest.mark.parametrize("rows", [4, 7, 28])
@pytest.mark.parametrize("needed", [None, 1])
def test_smoothing_agrees_with_pandas(spark, rows, needed):
    values = [math.sin(i) * i if i % 9 else None for i in range(40)]
    want = pd.Series(values, dtype=float).rolling(rows, center=True, min_periods=needed).mean()
    smooth = dp.smooth_metric(wide(spark, values), ["high"], "2024-01-01", "2024-12-31", rows, min_rows=needed)
    got = smooth.orderBy("date").toPandas()
    assert got.high.to_numpy(float) == pytest.approx(want.to_numpy(), nan_ok=True)
    assert got.high_upper.to_numpy(float) == pytest.approx(3 * want.to_numpy(), nan_ok=True)


def test_range_of_full_trailing_windows(spark):
    low, high = dp.smoothed_range(wide(spark, [1.0, 2.0, 9.0, 4.0]), ["high"], "2024-01-01", "2024-01-03", 2).select(
        "lowest", "highest").first()
    assert (low, high) == (1.5, 5.5)


def stops(spark, rows):
    """(user, day, geom, kind[, start])."""
    return spark.createDataFrame([(u, day(d), s[0] if s else 0, g, "H", k) for u, d, g, k, *s in rows],
                                 "user_id string, date_trunc date, t_start long, geom_id string, location_type string,"
                                 " urban_rural string")


def test_moves_between_homes(spark):
    rows = [("u", 0, "c", "urban"), ("u", 0, "r", "rural", 5), ("u", 1, "r", "rural"), ("u", 3, "c", "urban")]
    got = [(r.change, r.gap, r.rand_gap) for r in dp.home_moves(stops(spark, rows)).orderBy("gap").collect()]
    assert got == [("urban to rural", 0, 0), ("no change", 1, 0), ("rural to urban", 2, 0)]


def test_moved_dates_stay_inside_the_gap_and_repeat(spark):
    rows = [(f"u{i}", d, "c", "urban") for i in range(200) for d in (0, 12)]
    moves = dp.home_moves(stops(spark, rows), seed=4)
    drawn = {r.user_id: r.rand_gap for r in moves.collect()}
    assert set(drawn.values()) == set(range(-10, 1))
    assert drawn == {r.user_id: r.rand_gap for r in dp.home_moves(stops(spark, rows).repartition(7), seed=4).collect()}
    assert drawn != {r.user_id: r.rand_gap for r in dp.home_moves(stops(spark, rows), seed=5).collect()}


def test_net_rural_fills_within_a_label_only(spark):
    counts = spark.createDataFrame(
        [(day(0), "high", "urban to rural", 2, "XX"), (day(1), "high", "rural to urban", 1, "XX"),
         (day(2), "high", "urban to rural", 3, "XX"), (day(0), "low", "urban to rural", 5, "XX"),
         (day(1), "low", "no change", 9, "XX"), (day(9), "high", "urban to rural", 100, "XX"),
         (day(0), "high", "urban to rural", 70, "YY")],
        "date date, wealth_label string, change string, n_users long, country string")
    users = spark.createDataFrame([("a", "high", "XX"), ("b", "high", "XX"), ("c", "low", "XX"), ("d", "high", "YY")],
                                  "user_id string, wealth_label string, country string")
    got = {(r.wealth_label, r.date): r for r in dp.net_rural(counts, users, "XX", "2024-01-10").collect()}
    high = [got["high", day(d)].net_rural for d in range(3)]
    assert high == [1, 4, 4] and got["high", day(0)].net_rural_fraction == 50.0
    assert got["low", day(1)].to_rural == 5 and got["low", day(1)].net_rural is None and ("high", day(9)) not in got
    plain = dp.net_rural_by_label(counts, users, "XX", "2024-01-10", ["high", "low"], None).orderBy("date").collect()
    assert [r.high for r in plain] == [50.0, 200.0, 200.0] and plain[0].low is None


@pytest.mark.parametrize("rows", [3, 6])
def test_migration_smoothing_agrees_with_pandas(spark, rows):
    values = [float((i * 7) % 11) if i % 6 else None for i in range(25)]
    data = spark.createDataFrame([("XX", day(i), v) for i, v in enumerate(values)], "state string, date date, high double")
    rolling = pd.Series(values, dtype=float).rolling(rows, center=True, min_periods=1)
    got = dp.smooth_migration(data, ["high"], "2024-01-01", "2024-12-31", rows, pandas_sem=True).orderBy("date").toPandas()
    assert got.high.to_numpy(float) == pytest.approx(rolling.mean().to_numpy(), nan_ok=True)
    assert got.high_StdErr.to_numpy(float) == pytest.approx(rolling.sem().to_numpy(), nan_ok=True)


def test_city_and_country_migration(spark):
    admins = spark.createDataFrame(
        [("XX", "c1", "City", 50.0, 5.0), ("XX", "c2", "City", 50.0, 1.0), ("XX", "r1", None, 10.0, 2.0),
         ("XX", "t1", "Town", 5.0, 3.0)],
        "country string, geom_id string, metro_area_name string, pop double, wealth_index double")
    rows = [(u, d, 1, "H", 60, g) for u, homes in {"goes": ["c1", "c1", "r1"], "stays": ["c2", "c2", "c2"],
            "town": ["t1", "t1", "r1"]}.items() for d, g in enumerate(homes)]
    labelled = pieces(spark, rows).withColumn("t_start", F.unix_timestamp("date"))
    budgets = dp.time_budgets(labelled)
    activity = dp.ActivityParams(level=0.1, split="2024-01-03", end="2025-01-01")
    counts, users = dp.city_migration(labelled, budgets, admins, BINS, LABELS, "XX", activity)
    assert {(r.date, r.wealth_label, r.change, r.n_users) for r in counts.collect()} == {
        (day(1), "medium", "no change", 1), (day(2), "medium", "urban to rural", 1),
        (day(1), "low", "no change", 1), (day(2), "low", "no change", 1)}
    assert {(r.user_id, r.wealth_label, r.tot) for r in users.collect()} == {("goes", "medium", 3), ("stays", "low", 3)}
    rural = dp.country_migration(labelled, budgets, admins, BINS, LABELS, "XX", activity)
    assert {(r.date, r.change) for r in rural.collect()} == {(day(1), "no change"), (day(2), "urban to rural")}


def test_countries_with_colliding_ids_are_kept_apart(spark):
    """The plan over all countries equals one run per country, whose units and users carry the same ids."""
    from datetime import date

    stops = "country string, user_id string, date_trunc date, t_start long, geom_id string, location_type string"
    rows, days = [], []
    for country, moved in (("A", 3), ("B", 6), ("C", 2)):
        for user in ("u", "v"):
            for day in range(1, 9):
                rows.append((country, user, date(2024, 1, day), day * 86_400, "1" if day < moved else "2", "H"))
                days.append((country, user, date(2024, 1, day)))
    days = [d for d in days if not (d[0] == "B" and d[1] == "v" and d[2].day > 1)]  # v is hardly active in B
    units = spark.createDataFrame(
        [(c, g, m, 10.0, w) for c in "ABC" for g, m, w in (("1", "city", 2.0), ("2", None, 1.0))],
        "country string, geom_id string, metro_area_name string, pop double, wealth_index double")
    labelled, budgets = spark.createDataFrame(rows, stops), spark.createDataFrame(days, "country string, user_id string, date_trunc date")
    budgets = budgets.selectExpr("*", "1D as H", "null as W", "null as O")
    activity = {"A": dp.ActivityParams(level=0.5, split="2024-01-05", end="2024-02-01"),
                "B": dp.ActivityParams(level=0.5, split="2024-01-05", end="2024-02-01")}
    for seen_rural, plan in ((False, lambda *a: dp.city_migration(*a)[0]), (True, dp.country_migration)):
        got = dp.migration_of_countries(labelled, budgets, units, [0, 1], ["all"], activity, seen_rural)
        want = [tuple(r) for c in "AB" for r in plan(
            labelled.where(f"country = '{c}'"), budgets.where(f"country = '{c}'"), units, [0, 1], ["all"], c, activity[c])
            .select("date", "wealth_label", "change", "n_users", "country").collect()]
        got = sorted(tuple(r) for r in got.collect())
        assert got == sorted(want)
        assert {(r[0].day, r[3], r[4]) for r in got if r[2] == "urban to rural"} == {(3, 2, "A"), (6, 1, "B")}
