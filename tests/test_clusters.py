"""Clustering against brute force, on every route."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

import dwellpath as dp
from dwellpath.operators import clusters

R = 6_371_000.0
STOP = "user_id string, t_start long, t_end long, lat double, lon double"


def brute_force(frame: pd.DataFrame, radius: float) -> list[int]:
    labels = {}
    for _, group in frame.groupby("user_id"):
        group = group.sort_values(["t_start", "t_end", "lat", "lon"])
        lat, lon = np.radians(group.lat.values), np.radians(group.lon.values)
        chord = (np.sin((lat[:, None] - lat) / 2) ** 2
                 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2)
        near = 2 * R * np.arcsin(np.minimum(1, np.sqrt(chord))) <= radius
        found = -np.ones(len(group), int)
        for i in range(len(group)):
            if found[i] < 0:
                found[i], todo = found.max() + 1, [i]
                while todo:
                    fresh = np.flatnonzero(near[todo.pop()] & (found < 0))
                    found[fresh] = found[i]
                    todo.extend(fresh)
        labels.update(zip(group.index, found))
    return [int(labels[i]) for i in frame.index]


def scattered(seed: int, spread: float = 0.0003) -> pd.DataFrame:
    """Clouds of stops near the equator, a mid latitude, the antimeridian and the poles."""
    rng = np.random.default_rng(seed)
    rows = []
    for user, (lat, lon) in {"equator": (0, 0), "mid": (45, 7), "date line": (-17, 180), "north": (89.9995, 10),
                             "south": (-89.995, -170)}.items():
        widen = 1 / max(np.cos(np.radians(abs(lat))), 1e-3)
        for _ in range(25):
            a, b = lat + rng.normal() * 0.004, lon + rng.normal() * 0.004 * widen
            for _ in range(5):
                t = len(rows) * 1000
                rows.append((user, t, t + 500, float(np.clip(a + rng.normal() * spread, -89.9999, 89.9999)),
                             float((b + rng.normal() * spread + 180) % 360 - 180)))
    return pd.DataFrame(rows, columns=["user_id", "t_start", "t_end", "lat", "lon"])


def labels_of(spark, frame: pd.DataFrame, radius: float) -> list[int]:
    got = dp.cluster_stops(spark.createDataFrame(frame, STOP), radius).toPandas()
    return got.sort_values("t_start").cluster_label.tolist()


@pytest.mark.parametrize("radius", [60.0, clusters.CLUSTER_RADIUS_M])
def test_matches_brute_force(spark, radius):
    frame = scattered(3)
    assert labels_of(spark, frame, radius) == brute_force(frame, radius)


@pytest.mark.parametrize("side", [1, 3])
def test_components_across_regions_equal_those_within(spark, monkeypatch, side):
    frame = scattered(5, spread=0.0008)
    monkeypatch.setattr(clusters, "REGION", side)
    assert labels_of(spark, frame, 150.0) == brute_force(frame, 150.0)


FULL = STOP + ", median_accuracy double, total_pings_stop long"


@pytest.mark.parametrize("share", [0.02, 0.3, 0.7])
@pytest.mark.parametrize("side", [2, 512])
def test_inserted_stops_give_the_clusters_of_all_stops(spark, monkeypatch, share, side):
    """New stops before, between and after stored ones; some bridge clusters, some users have none."""
    monkeypatch.setattr(clusters, "REGION", side)
    frame = scattered(9, spread=0.0006).assign(median_accuracy=5.0, total_pings_stop=2)
    frame["median_accuracy"] = frame.median_accuracy + np.arange(len(frame))
    rng = np.random.default_rng(4)
    fresh = (rng.random(len(frame)) < share) & (frame.user_id != "mid")
    stored = frame[~fresh].copy()
    stored["cluster_label"] = brute_force(stored.reset_index(drop=True), 150.0)
    # labels count from 0 in order of first stops, but gaps and a missing label do no harm
    stored["cluster_label"] = stored.cluster_label.astype("float") * 3
    odd = (stored.index % 50 == 7) & (stored.user_id != "mid")
    history = [(*row[:-1], None if o else int(row[-1])) for row, o in zip(stored.itertuples(index=False), odd)]
    got = dp.recluster(spark.createDataFrame(history, FULL + ", cluster_label long"),
                       spark.createDataFrame(frame[fresh], FULL), 150.0, history_radius_m=150.0).toPandas()
    got = got.sort_values("median_accuracy").cluster_label.tolist()
    want = pd.Series(brute_force(frame, 150.0))
    quiet = frame.user_id == "mid"
    assert [g for g, q in zip(got, quiet) if not q] == want[~quiet].tolist()
    assert [g for g, q in zip(got, quiet) if q] == (want[quiet] * 3).tolist()


def test_only_cells_in_reach_of_new_stops_are_compared(spark, monkeypatch):
    seen = []
    plain = clusters._touching_cells
    monkeypatch.setattr(clusters, "_touching_cells", lambda celled, cells, grid: (seen.append(cells.count()), plain(celled, cells, grid))[1])
    old = [("u", i * 1000, i * 1000 + 500, float(i), 0.0, 5.0, 2, i) for i in range(80)]
    new = [("u", 500_000, 500_600, 3.0005, 0.0, 5.0, 2), ("u", 600_000, 600_600, -5.0, 0.0, 5.0, 2)]
    got = dp.recluster(spark.createDataFrame(old, FULL + ", cluster_label long"), spark.createDataFrame(new, FULL))
    assert [r.cluster_label for r in got.orderBy("t_start").collect()] == [*range(80), 3, 80]
    assert seen == [3]


def test_two_dense_places_at_the_limit_are_decided_without_all_pairs(spark):
    """Two places whose nearest stops are a hair below or above the radius apart."""
    rng = np.random.default_rng(0)
    step = np.degrees(1 / R)
    for gap, clusters_wanted in ((199.999, 1), (200.001, 2)):
        west = [(float(10 + rng.uniform(-60, 60) * step), float(-rng.uniform(0.01, 60) * step)) for _ in range(300)]
        east = [(float(10 + rng.uniform(-60, 60) * step), float((gap + rng.uniform(0.01, 60)) * step)) for _ in range(300)]
        cos = np.cos(np.radians(10.0))
        points = [(10.0, 0.0), (10.0, gap * step / cos)] + [(a, b / cos) for a, b in west] + [(a, b / cos) for a, b in east]
        frame = pd.DataFrame([("u", i * 1000, i * 1000 + 500, a, b) for i, (a, b) in enumerate(points)],
                             columns=["user_id", "t_start", "t_end", "lat", "lon"])
        got = labels_of(spark, frame, 200.0)
        assert got == brute_force(frame, 200.0)
        assert len(set(got)) == clusters_wanted


def test_chain_and_date_line(spark):
    step = float(np.degrees(150 / R))
    frame = pd.DataFrame([("chain", 0, 1, 0.0, 0.0), ("chain", 10, 11, 0.0, step), ("chain", 20, 21, 0.0, 2 * step),
                          ("line", 30, 31, 0.0, 179.9995), ("line", 40, 41, 0.0, -179.9995)],
                         columns=["user_id", "t_start", "t_end", "lat", "lon"])
    assert labels_of(spark, frame, clusters.CLUSTER_RADIUS_M) == [0, 0, 0, 0, 0]


def test_labels_follow_the_earliest_stop_whatever_the_input_order(spark):
    rows = [("u", 86_400 * d, 86_400 * d + 300, float(d % 3), 0.0) for d in range(9)]
    got = dp.cluster_stops(spark.createDataFrame(rows[::-1], STOP)).orderBy("t_start").collect()
    assert [row.cluster_label for row in got] == [0, 1, 2] * 3


def test_recluster_replaces_old_labels_and_adds_durations(spark):
    full = "user_id string, t_start long, t_end long, lat double, lon double, median_accuracy double, total_pings_stop long"
    old = spark.createDataFrame([("u", 0, 600, 1.0, 1.0, 5.0, 3, 77)], full + ", cluster_label long")
    new = spark.createDataFrame([("u", 9000, 9300, 1.0, 1.0, 5.0, 2), ("u", 99_000, 99_900, 2.0, 1.0, 5.0, 2)], full)
    got = dp.recluster(old, new).orderBy("t_start").collect()
    assert [(r.cluster_label, r.duration, r.total_duration_stop_location) for r in got] == [
        (0, 600, 600), (0, 300, 300), (1, 900, 900)]


def test_most_frequent_label(spark):
    rows = [("u", 2), ("u", 1), ("u", 2), ("u", 1), ("v", None), ("w", 5)]
    got = dp.most_frequent_label(spark.createDataFrame(rows, "user_id string, cluster_label long"), ["user_id"]).collect()
    assert {row.user_id: row.most_frequent_label for row in got} == {"u": 1, "w": 5}
