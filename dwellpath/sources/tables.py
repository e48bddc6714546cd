"""A1, A2, A4: pings and admin units."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellpath.schema import ADMINS, PINGS, require_columns

# Column names of a raw ping extract, and what they become.
RAW_PING_COLUMNS = {
    "uid": "user_id",
    "datetime": "datetime",
    "country": "country",
    "latitude": "lat",
    "longitude": "lon",
    "horizontal_accuracy": "accuracy",
}

# Shortened names some admin files carry.
ADMIN_ALIASES = {"metro_ar_1": "metro_area_name", "wealth_ind": "wealth_index"}


def prepare_pings(raw: DataFrame, columns: Mapping[str, str] = RAW_PING_COLUMNS) -> DataFrame:
    """A1/A2: canonical names and types, epoch seconds from a timestamp.

    Without a ``ping_id`` one is derived from the row's content, so pings that share
    a second always sort the same way.
    """
    named = raw.select([F.col(c).alias(columns.get(c, c)) for c in raw.columns])
    if "epoch_time" not in named.columns:
        require_columns(named, "datetime")
        named = named.withColumn("epoch_time", F.unix_seconds(F.col("datetime").cast("timestamp")))
    if "country" not in named.columns:
        named = named.withColumn("country", F.lit(None).cast("string"))
    if "ping_id" not in named.columns:
        named = named.withColumn("ping_id", F.xxhash64("lat", "lon", "accuracy"))
    return named.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in PINGS.fields])


def read_pings(spark: SparkSession, path: str, schema: T.StructType | None = None,
               columns: Mapping[str, str] = RAW_PING_COLUMNS) -> DataFrame:
    """A1: pings from parquet; only the columns used later are read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return prepare_pings(reader.parquet(path), columns)


def read_admins(spark: SparkSession, path: str, country: str) -> DataFrame:
    """A4: ``<path>/<country>/admin.csv`` with a header, as typed admin units.

    The file may hold further columns in any order, so the header decides the
    order and the types are applied by casts; no pass over the data infers them.
    """
    raw = spark.read.option("header", "true").csv(f"{path.rstrip('/')}/{country}/admin.csv")
    named = raw.select([F.col(f"`{c}`").alias(ADMIN_ALIASES.get(c, c)) for c in raw.columns])
    require_columns(named, "geom_id", "metro_area_name", "pop", "wealth_index")
    named = named.withColumn("country", F.lit(country))
    return named.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in ADMINS.fields])
