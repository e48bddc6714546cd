"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellpath.session import ensure_checkpoint_dir

# ASCII white space, which separates words.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or with underscores appended, so that it clashes with no column of ``df``."""
    taken = {name.lower() for name in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that to a text of plain ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most ``rows`` rows and about ``size`` bytes, or one row."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes the empty text."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


SIEVE_BITS = 23


def sieve(marks: DataFrame) -> Callable[[Column], Column]:
    """A filter that lets every 64-bit hash in ``marks`` (column ``mark``) pass, and few others.

    A bit set of fixed size, put together from the tasks' own; the more hashes it holds, the more
    others it lets pass, so what it excludes is certain at every size.
    """
    def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = hashes.astype(np.uint64)
        last = np.uint64((1 << SIEVE_BITS) - 1)
        return (wide & last).astype(np.int64), (wide >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            for place in places(batch.column(0).to_numpy()):
                flags[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for row in marks.coalesce(16).mapInArrow(collect, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    shared = marks.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def passes(hashes: pd.Series) -> pd.Series:
        first, second = places(hashes.to_numpy())
        held = shared.value
        one, two = (held[place >> 3] >> (7 - (place & 7)) & 1 for place in (first, second))
        return pd.Series((one & two).astype(bool))

    return passes
