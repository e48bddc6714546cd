"""WARC archives with content-addressed payloads.

An archive has two parts.  ``payloads`` holds every distinct payload once, under its
SHA-256; ``records`` holds the exact header block of every record and the digest of its
payload.  Records are reconstructed by joining the two, and each payload is checked
against its digest as it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellpath.llm.common import shared_path, table
from dwellpath.session import cut_lineage

MIN_REVISIT_BYTES = 1000


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header_value(value: Column) -> Column:
    """Line ends cannot stand in a header field; they are percent-encoded."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``); returns ``path``.

    Of rows with equal payloads of ``min_bytes`` or more, those of the largest ``page_id``
    become ``response`` records and the others ``revisit`` records that refer to it; all
    others are ``response``.  A null html is an empty payload, a null id is below all
    others, a null url is an empty field.  Repeated rows are repeated records.  Further
    columns are not archived.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digested = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    named = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    index = cut_lineage(digested.select(
        "page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1")))
    # max ignores nulls: a payload whose pages all lack an id has the keeper null, and all are responses
    keepers = index.groupBy("digest").agg(F.max("page_id").alias("keeper"))
    # of each payload the rows of one page; more than one can only be repeats of that page
    chosen = keepers.select("digest", F.coalesce(F.col("keeper").cast("string"), F.lit("none")).alias("page"))
    stored = digested.select(named.alias("page"), "digest", "payload").join(chosen, ["digest", "page"], "left_semi")
    stored.groupBy("digest", "page").agg(F.first("payload").alias("payload")).select("digest", "payload").write.parquet(
        f"{path}/payloads")
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _record_id(F.col("page_id"))),
        _field("WARC-Target-URI", _header_value(F.col("url"))),
        F.when(revisit, F.concat(
            _field("WARC-Refers-To", _record_id(F.col("keeper"))),
            _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(F.lit("")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"))
    index.join(keepers, "digest").select("digest", header.cast("binary").alias("header")).write.parquet(f"{path}/records")
    return path


def _header_field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"(?dm)^{name}: (.*?)\r?$", 1)


def _page(field: Column) -> Column:
    return F.regexp_extract(field, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive with their payloads, one row per record.

    ``header`` is the exact header block; ``payload`` the full payload, also of a revisit.
    ``stored_sha1`` and ``stored_bytes`` are computed from the stored payload as it is read.
    A payload that does not match the digest it is stored under, or the header's, fails.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))).alias("digest"),
        "payload", F.sha1("payload").alias("stored_sha1"), F.octet_length("payload").cast("long").alias("stored_bytes"))
    records = spark.read.parquet(f"{path}/records").select(
        "digest", "header", _header_field("WARC-Type").alias("record_type"),
        _page(_header_field("WARC-Record-ID")).alias("page_id"), _header_field("WARC-Target-URI").alias("url"),
        _page(_header_field("WARC-Refers-To")).alias("refers_to"),
        F.substring(_header_field("WARC-Payload-Digest"), 6, 40).alias("header_sha1"))
    joined = records.join(stored, "digest", "left")
    sound = F.coalesce(F.col("stored_sha1") == F.col("header_sha1"), F.lit(False))
    return joined.withColumn("stored_sha1", F.when(sound, F.col("stored_sha1")).otherwise(
        F.raise_error(F.concat(F.lit("payload and header differ: "), F.col("digest")))))


def record_bytes(records: DataFrame) -> DataFrame:
    """``page_id`` and ``record``, the bytes of each record as they stand in a WARC file."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read_archive(spark, path).select(
        "page_id", F.col("stored_bytes").alias("payload_bytes"), F.col("stored_sha1").alias("payload_digest"),
        "record_type", "refers_to")


OP9_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha1(payload) as digest, payload from p),
k as (select payload, max(page_id) as keeper from d group by payload)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.digest as payload_digest,
  case when d.n >= 1000 and d.page_id <> k.keeper then 'revisit' else 'response' end as record_type,
  case when d.n >= 1000 and d.page_id <> k.keeper then k.keeper end as refers_to
from d join k on d.payload = k.payload
"""
