"""Stages are replaced as a whole, whatever happens to their writers."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import dwellpath as dp
from dwellpath.sources import stages

ROWS = "user_id string, country string, n long"


def rows(spark, *values):
    return spark.createDataFrame([("u", country, n) for country, n in values], ROWS)


def held(spark, root, **kw):
    return sorted((r.country, r.n) for r in dp.read_stage(spark, root, "s", {}, **kw).collect())


def test_a_writer_that_dies_leaves_the_stage_as_it_was(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    dp.write_stage(rows(spark, ("BR", 1), ("MX", 2)), root, "s", {})
    before = dp.read_stage(spark, root, "s", {})
    # while rows are written: some files are there, the job fails
    failing = rows(spark, ("BR", 7), ("MX", 8)).repartition(2, "n").withColumn(
        "n", F.when(F.col("n") == 8, F.raise_error(F.lit("died")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="died"):
        dp.write_stage(failing, root, "s", {})
    assert held(spark, root) == [("BR", 1), ("MX", 2)]
    # after the rows, before the version
    with monkeypatch.context() as patch:
        patch.setattr(stages, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            dp.write_stage(rows(spark, ("BR", 9)), root, "s", {})
    assert held(spark, root) == [("BR", 1), ("MX", 2)]
    dp.write_stage(rows(spark, ("BR", 3)), root, "s", {})
    assert held(spark, root) == [("BR", 3), ("MX", 2)]
    # a reader that began with the earlier version keeps it until old files are removed
    assert sorted((r.country, r.n) for r in before.collect()) == [("BR", 1), ("MX", 2)]
    assert dp.clean_stage(spark, root, "s", {}) >= 1
    assert held(spark, root) == [("BR", 3), ("MX", 2)]
    path = stages.stage_path(root, "s", {})
    assert len(os.listdir(f"{path}/data")) == 2
    assert len([e for e in os.listdir(f"{path}/versions") if not e.startswith(".")]) == 1
    assert dp.clean_stage(spark, root, "s", {}) == 0


def test_two_writers_at_a_time_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    dp.write_stage(rows(spark, ("BR", 1)), root, "s", {})
    path = stages.stage_path(root, "s", {})
    stale, plain = [stages._newest(spark, path)], stages._newest
    dp.write_stage(rows(spark, ("MX", 2)), root, "s", {})
    monkeypatch.setattr(stages, "_newest", lambda *a: stale.pop() if stale else plain(*a))
    dp.write_stage(rows(spark, ("CO", 3)), root, "s", {})
    assert held(spark, root) == [("BR", 1), ("CO", 3), ("MX", 2)]


def test_append_empty_and_odd_countries(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        dp.read_stage(spark, root, "s", {})
    dp.write_stage(rows(spark), root, "s", {})
    assert held(spark, root) == [] and dp.read_stage(spark, root, "s", {}).columns == ["user_id", "n", "country"]
    dp.write_stage(rows(spark, ("BR", 1), ("a b/c%", 2)), root, "s", {})
    dp.write_stage(rows(spark, ("BR", 1), ("BR", 4)), root, "s", {}, mode="append")
    assert held(spark, root) == [("BR", 1), ("BR", 1), ("BR", 4), ("a b/c%", 2)]
    assert held(spark, root, country="a b/c%") == [("a b/c%", 2)] and held(spark, root, country="XX") == []
    dp.write_stage(rows(spark, (None, 5)), root, "s", {})
    assert len(dp.read_stage(spark, root, "s", {}).where("country is null").collect()) == 1
    with pytest.raises(ValueError):
        dp.write_stage(rows(spark), root, "s", {}, mode="ignore")
