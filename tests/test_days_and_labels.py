"""Day pieces and home/work labels: hand cases."""

from __future__ import annotations

import datetime as dt

import dwellpath as dp

DAY = 86_400
STOP = "user_id string, t_start long, t_end long, cluster_label long, total_pings_stop long"


def pieces_of(spark, visits):
    """Pieces from (user, cluster, day, start hour, hours[, pings]); days count from Monday 2024-01-01."""
    monday = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    rows = []
    for user, cluster, day, hour, hours, *pings in visits:
        start = monday + day * DAY + hour * 3600
        rows.append((user, start, start + int(hours * 3600), cluster, pings[0] if pings else 3))
    return dp.day_pieces(spark.createDataFrame(rows, STOP))


def types_of(labelled):
    return {(r.cluster_label, (r.date_trunc - dt.date(2024, 1, 1)).days): (r.location_type, r.home_label, r.work_label)
            for r in labelled.collect()}


def cut(spark, start, end):
    df = spark.createDataFrame([("u", start, end, 0, 2)], STOP)
    return sorted((r.t_start, r.t_end, r.duration, r.total_duration_stop_location) for r in dp.split_at_midnight(df).collect())


def test_cut_at_midnight(spark):
    assert cut(spark, 10, DAY) == [(10, DAY, DAY - 10, DAY - 10)]
    assert [p[:2] for p in cut(spark, 10, 2 * DAY + 5)] == [(10, DAY), (DAY, 2 * DAY), (2 * DAY, 2 * DAY + 5)]
    assert cut(spark, 10, 10) == [] and cut(spark, DAY, DAY) == []
    assert [p[:2] for p in cut(spark, 20, 10)] == [(20, 10)]
    assert [p[:2] for p in cut(spark, -5, 5)] == [(-5, 0), (0, 5)]
    assert sum(p[2] for p in cut(spark, 12_345, 9 * DAY + 777)) == 9 * DAY + 777 - 12_345


def test_piece_ending_at_midnight_counts_as_night(spark):
    (piece,) = pieces_of(spark, [("u", 0, 0, 20, 4)]).collect()
    assert (piece.t_start_hour, piece.t_end_hour, piece.weekday) == (20, 0, 2)
    assert dp.night_pieces(pieces_of(spark, [("u", 0, 0, 20, 4)])).count() == 1
    assert dp.night_pieces(pieces_of(spark, [("u", 0, 0, 20, 2)])).count() == 0


def test_home_needs_enough_days_inside_the_window(spark):
    assert types_of(dp.label_home(pieces_of(spark, [("u", 0, 0, 1, 2), ("u", 0, 14, 1, 2)])))[0, 14] == ("O", -1, -1)
    near = types_of(dp.label_home(pieces_of(spark, [("u", 0, 0, 1, 2), ("u", 0, 13, 1, 2)])))
    assert near[0, 13] == ("H", 0, -1) and near[0, 0] == ("O", -1, -1)


def test_home_pings_limit_is_strict(spark):
    visits = [("u", 0, 0, 1, 2, 1), ("u", 0, 1, 1, 2, 1)]
    assert types_of(dp.label_home(pieces_of(spark, visits)))[0, 1][0] == "O"
    assert types_of(dp.label_home(pieces_of(spark, visits), dp.LabelParams(min_pings_home=1)))[0, 1][0] == "H"


def test_lowest_cluster_is_home_when_two_qualify(spark):
    visits = [("u", c, d, 1 + c, 1) for c in (0, 1) for d in (0, 1)] + [("u", 1, 2, 1, 4)]
    got = types_of(dp.label_home(pieces_of(spark, visits)))
    assert got[0, 1][0] == "H" and got[1, 1][0] == "O" and got[1, 2][0] == "H"


def test_gaps_take_the_nearest_home_and_the_earlier_on_a_tie(spark):
    picks = spark.createDataFrame(
        [("two", dt.date(2024, 1, 1), 7), ("two", dt.date(2024, 1, 4), 9), ("three", dt.date(2024, 1, 1), 7),
         ("three", dt.date(2024, 1, 5), 9), ("one", dt.date(2024, 1, 1), 5)],
        "user_id string, date_trunc date, cluster_label long")
    got = {}
    for row in dp.fill_gaps(picks).orderBy("user_id", "date_trunc").collect():
        got.setdefault(row.user_id, []).append((row.cluster_label, row.observed))
    assert got == {
        "one": [(5, True)],
        "two": [(7, True), (7, False), (9, False), (9, True)],
        "three": [(7, True), (7, False), (7, False), (9, False), (9, True)],
    }


def test_filled_days_are_typed_but_not_labelled(spark):
    visits = [("u", 0, d, 1, 2) for d in (0, 1, 5)] + [("u", 0, 3, 12, 1)]
    assert types_of(dp.label_home(pieces_of(spark, visits)))[0, 3] == ("H", -1, -1)


def test_work_on_weekdays_only_and_never_at_home(spark):
    nights = [("u", 0, d, 1, 2) for d in range(12)]
    home_by_day = [("u", 0, d, 10, 2) for d in range(12)]
    office = [("u", 4, d, 10, 2) for d in range(12)]
    got = types_of(dp.label_home_and_work(pieces_of(spark, nights + home_by_day + office)))
    assert got[4, 3] == ("O", -1, -1)  # fourth weekday, five are needed
    assert got[4, 4] == ("W", -1, 4)
    assert got[4, 5] == ("W", -1, -1) and got[4, 6] == ("W", -1, -1)  # weekend, filled between Friday and Monday
    assert got[0, 8][0] == "H"


def test_two_works_on_one_day_are_both_labelled(spark):
    visits = [("u", c, d, 9 + 3 * (c - 3), 2) for c in (3, 4) for d in range(5)]
    got = types_of(dp.label_home_and_work(pieces_of(spark, visits)))
    assert got[3, 4] == ("W", -1, 3) and got[4, 4] == ("O", -1, 4)


def test_both_labels_at_once_or_one_after_the_other(spark):
    visits = [(u, (d * k) % 3 // 2 + (2 if 9 < h < 20 else 0), d, h, 1 + d % 2) for u, k in (("a", 3), ("b", 5), ("c", 2))
              for d in range(30) if d % 7 != k for h in (1, 10, 14, 22)]
    pieces = pieces_of(spark, visits)
    together = dp.label_home_and_work(pieces)
    apart = dp.label_work(dp.label_home(pieces))
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect()))
    assert {r.location_type for r in together.select("location_type").distinct().collect()} == {"H", "W", "O"}


def test_shares_of_days(spark):
    pieces = pieces_of(spark, [("u", 0, 0, 1, 1), ("u", 1, 0, 5, 3), ("u", 0, 3, 1, 1), ("u", 1, 14, 1, 1)])
    share = {(r.cluster_label, r.date_trunc.day): r.day_share for r in dp.day_share(pieces).collect()}
    assert share[0, 1] == 0.25 and share[1, 1] == 0.75
    active = {(r.cluster_label, r.date_trunc.day): (r.cluster_days, r.active_days)
              for r in dp.active_day_share(pieces, 14).collect()}
    assert active == {(0, 1): (1, 1), (1, 1): (1, 1), (0, 4): (2, 2), (1, 15): (2, 3)}


def test_start_hours_leave_out_midnight(spark):
    labelled = dp.initialise_labels(pieces_of(spark, [("u", 0, 0, 23, 2), ("u", 0, 1, 9, 1)]))
    got = {(r.weekday, r.t_start_hour): r.pieces for r in dp.start_hour_histogram(labelled).collect()}
    assert got == {(2, 23): 1, (3, 9): 1}


def test_labels_shuffle_each_kind_of_evidence_once(spark):
    pieces = spark.createDataFrame([], pieces_of(spark, [("u", 0, 0, 1, 1)]).schema)
    plan = dp.label_home_and_work(pieces)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 9 and "Python" not in plan and "InPandas" not in plan
