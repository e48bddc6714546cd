"""Readers, writers and ping preparation."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import types as T

import dwellpath as dp
from dwellpath import schema


def test_raw_pings_get_canonical_names_and_seconds(spark, tmp_path):
    raw = spark.createDataFrame(
        [("u", dt.datetime(2024, 1, 1, 0, 0, 1, 900_000), "BR", 1.0, 2.0, 3.0)],
        "uid string, datetime timestamp, country string, latitude double, longitude double, horizontal_accuracy double")
    raw.write.parquet(str(tmp_path / "raw"))
    pings = dp.read_pings(spark, str(tmp_path / "raw"))
    assert pings.schema.fieldNames() == schema.PINGS.fieldNames()
    row = pings.first()
    assert (row.user_id, row.epoch_time, row.lat, row.lon, row.accuracy) == ("u", 1704067201, 1.0, 2.0, 3.0)
    assert dp.read_pings(spark, str(tmp_path / "raw")).first().ping_id == row.ping_id


def test_admin_csv_has_types_and_known_aliases(spark, tmp_path):
    (tmp_path / "XX").mkdir()
    (tmp_path / "XX" / "admin.csv").write_text("wealth_ind,geom_id,extra,pop,metro_ar_1\n0.5,001,z,12,City\n,002,z,7,\n")
    rows = {r.geom_id: r for r in dp.read_admins(spark, str(tmp_path), "XX").collect()}
    assert rows["001"]["pop"] == 12.0 and rows["001"].wealth_index == 0.5 and rows["001"].metro_area_name == "City"
    assert rows["002"].metro_area_name is None and rows["002"].wealth_index is None and rows["002"].country == "XX"


def test_stages_are_found_by_their_run_and_pruned_by_country(spark, tmp_path):
    df = spark.createDataFrame([("a", "BR", 1), ("b", "MX", 2)], "user_id string, country string, n long")
    run = {"hw": 14, "ww": 28}
    dp.write_stage(df, str(tmp_path), "durations", run)
    assert dp.read_stage(spark, str(tmp_path), "durations", run).count() == 2
    one = dp.read_stage(spark, str(tmp_path), "durations", run, "MX")
    assert [r.user_id for r in one.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(country" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception):
        dp.read_stage(spark, str(tmp_path), "durations", {"hw": 28, "ww": 28})


def test_countries_written_one_by_one_stay(spark, tmp_path):
    rows = spark.createDataFrame([("a", "BR", 1), ("b", "CO", 2)], "user_id string, country string, n long")
    for country in ("BR", "CO", "BR"):
        dp.write_stage(rows.where(rows.country == country), str(tmp_path), "durations", {})
    typed = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("n", T.LongType())])
    back = dp.read_stage(spark, str(tmp_path), "durations", {}, schema=typed)
    assert sorted(map(tuple, back.collect())) == [("a", 1, "BR"), ("b", 2, "CO")]


PING = "user_id string, ping_id long, country string, epoch_time long, lat double, lon double"


def test_local_time_follows_the_zone_and_its_offset_changes(spark):
    pings = spark.createDataFrame([("u", 0, "MX", 1672531200, 0.0, 0.0), ("u", 1, "NY", 1672531200, 0.0, 0.0),
                                   ("u", 2, "NY", 1688169600, 0.0, 0.0), ("u", 3, "??", 5, 0.0, 0.0)], PING)
    zones = spark.createDataFrame([("MX", "America/Mexico_City"), ("NY", "America/New_York")],
                                  "country string, timezone string")
    got = {r.ping_id: r.epoch_time for r in dp.localise(pings, zones).collect()}
    assert got == {0: 1672531200 - 6 * 3600, 1: 1672531200 - 5 * 3600, 2: 1688169600 - 4 * 3600, 3: 5}


def test_most_observed_user_and_hourly_share(spark):
    rows = [("b", 0, "BR", 7200, 1.0, 1.0), ("b", 1, "BR", 3600, 2.0, 2.0), ("a", 2, "BR", 3600, 3.0, 3.0),
            ("a", 3, "BR", 3601, 4.0, 4.0), ("c", 4, "MX", 0, 5.0, 5.0)]
    pings = spark.createDataFrame(rows, PING)
    top = {r.country: (r.user_id, r.observations, r.lat) for r in dp.most_observed_users(pings).collect()}
    assert top == {"BR": ("a", 2, 3.0), "MX": ("c", 1, 5.0)}
    assert {(r.country, r.hour): r.pct for r in dp.hourly_share(pings).collect()} == {
        ("BR", 1): 75.0, ("BR", 2): 25.0, ("MX", 0): 100.0}


def test_counting_observations_sorts_no_pings(spark):
    pings = spark.createDataFrame([], PING)
    plan = dp.most_observed_users(pings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 2  # choosing among the few users with the highest count


def test_a_session_in_another_zone_is_refused(spark):
    pings = spark.createDataFrame([], PING)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Manila")
    try:
        with pytest.raises(ValueError, match="UTC"):
            dp.hourly_share(pings)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="lat"):
        dp.validation_report(spark.createDataFrame([], "user_id string, epoch_time long"))


def test_written_stages_can_be_removed(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        (file,) = dp.cut_lineage(spark.range(3).coalesce(1)).inputFiles()
        assert os.path.exists(file.removeprefix("file://"))
        dp.remove_stages(spark)
        assert not os.path.exists(file.removeprefix("file://"))
    finally:
        if before is not None:
            spark.sparkContext.setCheckpointDir(before)
