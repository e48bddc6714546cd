"""Domain tables derived from the driver's ``events``, ``supplier`` and ``nation``.

The derivation is described in FIXTURES.md.  Every row of the source tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Countries of the sample and their time zones.
ZONES = {
    "BR": "America/Sao_Paulo",
    "CO": "America/Bogota",
    "ID": "Asia/Jakarta",
    "MX": "America/Mexico_City",
    "PH": "Asia/Manila",
}

_PINGS_SQL = """
with v as (
  select event_id, user_id, unix_seconds(cast(ts as timestamp)) as b, hour(ts) as h,
         dayofweek(ts) - 1 as dow0, cast(ts as date) as d
  from {events}),
a as (
  select *, case when h >= 21 or h < 8 then 0
                 when h < 17 and dow0 between 1 and 5 and event_id % 5 <> 0 then 1
                 else 2 + event_id % 5 end as place0 from v),
m as (
  select *, case when place0 = 0 and event_id % 4 = 0 then 7
                 when place0 = 0 and user_id % 3 = 0 and d >= date '2024-01-16' then 9
                 else place0 end as place from a),
k as (select *, explode(sequence(0L, 1 + event_id % 4)) as k from m)
select cast(user_id as string) as user_id,
  event_id * 8 + k as ping_id,
  b + k * (case when event_id % 6 = 0 then 120 else 300 end) as epoch_time,
  cast(-30 + (user_id * 37) % 60 as double) + cast(place as double) * 0.02D
    + cast((event_id * 31 + k * 17) % 21 - 10 as double) * 0.00001D as lat,
  cast(-100 + (user_id * 53) % 200 as double) + cast(place as double) * 0.02D
    + cast((event_id * 29 + k * 13) % 21 - 10 as double) * 0.00001D as lon,
  cast(5 + (event_id * 13 + k * 3) % 240 as double) as accuracy,
  case user_id % 5 when 0 then 'BR' when 1 then 'CO' when 2 then 'ID' when 3 then 'MX' else 'PH' end as country
from k
"""


# The same events as noisier tracks: more pings per visit, places 222 m apart, noise of up to
# 55 m per axis, a drift along the visit, and pairs of pings that share a second.
_HARD_PINGS_SQL = _PINGS_SQL[:_PINGS_SQL.index("k as (")] + """
k as (select *, explode(sequence(0L, 5 + event_id % 10)) as k from m)
select cast(user_id as string) as user_id,
  event_id * 16 + k as ping_id,
  b + (k div 2) * 150 as epoch_time,
  cast(-30 + (user_id * 37) % 60 as double) + cast(place as double) * 0.002D
    + cast((event_id * 7919 + k * 104729) % 1001 - 500 as double) * 0.00000103D + cast(k as double) * 0.00002D as lat,
  cast(-100 + (user_id * 53) % 200 as double) + cast(place % 3 as double) * 0.001D
    + cast((event_id * 6007 + k * 15485863) % 1001 - 500 as double) * 0.00000103D as lon,
  cast(5 + (event_id * 13 + k * 3) % 240 as double) as accuracy,
  case user_id % 5 when 0 then 'BR' when 1 then 'CO' when 2 then 'ID' when 3 then 'MX' else 'PH' end as country
from k
"""


# Every event as a ping of one device that lingers, drifts by metres and returns, with no pause and no jump that
# would surely end a stop.
_ONE_DEVICE_SQL = """
select 'device' as user_id, event_id as ping_id, 1700000000 + event_id * 97 as epoch_time,
  10 + cast((event_id div 41) % 3 as double) * 0.00055D + cast((event_id div 977) % 5 as double) * 0.0001D
    + cast((event_id * 7919) % 1001 - 500 as double) * 0.0000004D as lat,
  20 + cast((event_id * 6007) % 1001 - 500 as double) * 0.0000004D as lon,
  cast(5 + event_id % 240 as double) as accuracy, 'XX' as country
from {events}
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Events a task derives pings from: a split of a compressed file may hold many millions.
EVENTS_PER_TASK = 50_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    tasks = -(-events.count() // EVENTS_PER_TASK)
    return events.repartition(tasks, "event_id") if tasks > 1 else events


def sample_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PINGS_SQL, events=_events(spark, sf_dir))


def sample_hard_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HARD_PINGS_SQL, events=_events(spark, sf_dir))


def sample_one_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ONE_DEVICE_SQL, events=_events(spark, sf_dir))


def sample_zones(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{country}', '{zone}')" for country, zone in sorted(ZONES.items()))
    return spark.sql(f"select * from values {rows} as zones(country, timezone)")


def sample_admins(spark: SparkSession, sf_dir: str, countries: int = 1) -> DataFrame:
    """One admin unit per supplier; units of odd nations are rural.

    With ``countries`` > 1 the units are dealt to that many countries, else all
    belong to ``XX``.
    """
    key = F.col("s_suppkey")
    country = F.lit("XX") if countries == 1 else F.concat(F.lit("C"), (key % countries).cast("string"))
    return (
        _table(spark, sf_dir, "supplier")
        .join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            country.alias("country"),
            F.concat(F.lit("g"), key.cast("string")).alias("geom_id"),
            F.when(F.col("s_nationkey") % 2 == 0, F.col("n_name")).alias("metro_area_name"),
            (1000 + (key * 37) % 5000).cast("double").alias("pop"),
            F.col("s_acctbal").cast("double").alias("wealth_index"),
        )
    )


def with_geom_id(stops: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin unit of a stop: the place it sits at, dealt over all units."""
    units = _table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    user = F.col("user_id").cast("long")
    place = F.round((F.col("lat") - (-30 + (user * 37) % 60)) / 0.02).cast("long")
    return stops.withColumn("geom_id", F.concat(F.lit("g"), ((user * 7 + place) % units).cast("string")))


def with_country_of_user(rows: DataFrame, countries: int = 3) -> DataFrame:
    return rows.withColumn("country", F.concat(F.lit("C"), (F.col("user_id").cast("long") % countries).cast("string")))


def with_colliding_ids(rows: DataFrame, countries: int = 3) -> DataFrame:
    """Unit numbers of :func:`sample_admins` divided by the number of countries: unique within a country only."""
    number = F.floor(F.substring("geom_id", 2, 20).cast("long") / countries)
    return rows.withColumn("geom_id", F.concat(F.lit("g"), number.cast("string")))
