"""Exact medians by counting in ranges."""

from __future__ import annotations

import statistics

import numpy as np
import pytest

import dwellpath as dp
from dwellpath.functions import selection

GROUP = "g string, h long, value double"


@pytest.mark.parametrize("ranges", [2, 7, 16_384])
def test_medians_of_any_group(spark, monkeypatch, ranges):
    monkeypatch.setattr(selection, "RANGES", ranges)
    rng = np.random.default_rng(0)
    groups = {("one", 1): [3.0], ("two", 1): [1.0, 2.0], ("ties", 1): [5.0] * 6, ("half ties", 1): [1.0] * 4 + [2.0] * 4,
              ("odd", 2): rng.normal(size=101).tolist(), ("even", 2): rng.normal(size=100).tolist(),
              ("wide", 2): [-1e9, 1e-9, 2e-9, 1e12], (None, None): [0.0, -0.0, 7.0], ("one", 2): [float("inf"), 1.0, 2.0][1:],
              ("far apart", 3): [0.0] * 5 + [1.0] * 5}
    rows = [(*key, v) for key, values in groups.items() for v in values]
    got = {(r.g, r.h): r.median for r in dp.exact_medians(spark.createDataFrame(rows, GROUP), ["g", "h"]).collect()}
    assert got == {key: statistics.median(values) for key, values in groups.items()}


def test_unknown_values_make_the_median_unknown(spark):
    rows = [("a", 1, 1.0), ("a", 1, None), ("b", 1, float("nan")), ("b", 1, 2.0), ("c", 1, 4.0)]
    got = {r.g: r.median for r in dp.exact_medians(spark.createDataFrame(rows, GROUP), ["g", "h"]).collect()}
    assert got == {"a": None, "b": None, "c": 4.0}
    assert dp.exact_medians(spark.createDataFrame([], GROUP), ["g", "h"]).collect() == []
