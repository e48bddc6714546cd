"""Session checks and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def require_utc(spark: SparkSession) -> None:
    """Calendar fields are taken from wall-clock epochs, so the zone must be UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, is {zone}")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, removed when the
    program ends; on a cluster a machine-local folder would lose the data with the machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="dwellpath-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table under the shared checkpoint folder and read it from there.

    A written table is computed once, where an RDD checkpoint runs its last stage twice,
    and it brings column pruning and sizes the optimizer can use.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stages/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a written table beyond which joins shuffle it.  Columns that repeat shrink files so far that Spark, which goes
# by the size of files, would copy millions of rows to every task.
BROADCAST_ROWS = 200_000


def shuffled_if_long(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for joins, whose sides are sorted and merged if its ``rows`` are many; else Spark chooses."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def cut_for_joins(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` for a table that several joins of one plan read, each of which would copy it to the driver."""
    written = cut_lineage(df)
    return shuffled_if_long(written, written.count())


def dealt_by(df: DataFrame, rows: int, per_task: int, *keys: str) -> DataFrame:
    """Deal ``df`` by ``keys`` over enough tasks that each gets about ``per_task`` of its ``rows``.

    ``spark.sql.shuffle.partitions`` is kept unless it is too few for that.
    """
    tasks = -(-rows // per_task)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(*keys)
    return df.repartition(tasks, *keys)


def remove_stages(spark: SparkSession) -> None:
    """Remove all tables :func:`cut_lineage` has written in this application; nothing may read them afterwards."""
    root = spark.sparkContext.getCheckpointDir()
    if root is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/stages")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
