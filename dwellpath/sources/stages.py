"""A3, A5: persisted stages that are replaced as a whole.

A stage of a run is a folder with the files of every write under ``data`` and a list of
versions under ``versions``.  A write first puts its files aside, in a folder of its own;
only then is the next version published, by renaming one small file, which tells for each
country the writes that hold it.  Readers go by the newest version, so they see all of a
write or nothing of it, whether the writer is slow, dies, or is run again; and files of
earlier versions stay until :func:`clean_stage` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellpath.schema import require_columns

_WRITE = "stage_write"


def stage_path(root: str, stage: str, run: Mapping[str, object]) -> str:
    tag = "_".join(f"{key}-{run[key]}" for key in sorted(run)) or "default"
    return f"{root.rstrip('/')}/{stage}/{tag}"


def write_stage(df: DataFrame, root: str, stage: str, run: Mapping[str, object], mode: str = "overwrite") -> str:
    """A5: persist a stage of one run as parquet, partitioned by country.

    ``run`` holds the parameters that tell runs apart; they become the folder name, so a
    reader finds exactly the run it asks for.  ``overwrite`` replaces the countries that
    ``df`` holds and leaves the others, so a run may be written country by country, also by
    several writers at a time; ``append`` adds to them.
    """
    require_columns(df, "country")
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be 'overwrite' or 'append', not {mode!r}")
    spark, path, name = df.sparkSession, stage_path(root, stage, run), uuid.uuid4().hex
    folder = f"{path}/data/{_WRITE}={name}"
    df.write.partitionBy("country").parquet(folder)
    written = [entry.removeprefix("country=") for entry in _entries(spark, folder) if entry.startswith("country=")]
    while True:
        number, version = _newest(spark, path)
        held = dict(version["countries"]) if version else {}
        for country in written:
            held[country] = [name] if mode == "overwrite" else [*held.get(country, []), name]
        content = {"countries": held, "schema": df.drop("country").schema.jsonValue()}
        if _publish(spark, path, number + 1, content):
            return path


def read_stage(spark: SparkSession, root: str, stage: str, run: Mapping[str, object],
               country: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A3: the newest version of a stage; with ``country`` only its folders are read.

    With a ``schema`` (such as ``schema.LABELLED_PIECES`` or ``schema.BUDGETS``, plus
    ``country``) names and types are those asked for, else those of the last write; none
    are inferred from files or folders.
    """
    path = stage_path(root, stage, run)
    _, version = _newest(spark, path)
    if version is None:
        raise FileNotFoundError(f"no stage has been written to {path}")
    known = schema if schema is not None else T.StructType.fromJson(version["schema"])
    known = T.StructType([*(f for f in known.fields if f.name != "country"), T.StructField("country", T.StringType())])
    folders = [f"{path}/data/{_WRITE}={name}/country={held}" for held, names in sorted(version["countries"].items())
               if country is None or unquote(held) == country for name in names]
    if not folders:
        return spark.createDataFrame([], known)
    df = spark.read.schema(known.add(_WRITE, "string")).option("basePath", f"{path}/data").parquet(*folders).select(*known.names[:-1])
    return df if country is None else df.where(F.col("country") == country)


def clean_stage(spark: SparkSession, root: str, stage: str, run: Mapping[str, object]) -> int:
    """Remove what the newest version does not name: replaced files, those of writers that died, and old versions.

    To be run when no writer is at work and no reader still uses an earlier version.
    Returns the number of writes removed.
    """
    path = stage_path(root, stage, run)
    number, version = _newest(spark, path)
    used = {(name, held) for held, names in (version["countries"] if version else {}).items() for name in names}
    system, removed = _system(spark, path), 0
    for entry in _entries(spark, f"{path}/data"):
        name = entry.removeprefix(f"{_WRITE}=")
        stale = [held for held in _entries(spark, f"{path}/data/{entry}")
                 if held.startswith("country=") and (name, held.removeprefix("country=")) not in used]
        if not any(name == other for other, _ in used):
            removed += system.delete(_path(spark, f"{path}/data/{entry}"), True)
        else:
            for held in stale:
                system.delete(_path(spark, f"{path}/data/{entry}/{held}"), True)
    for entry in _entries(spark, f"{path}/versions"):
        if entry != f"{number:012d}":
            system.delete(_path(spark, f"{path}/versions/{entry}"), False)
    return removed


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, folder: str) -> list[str]:
    system = _system(spark, folder)
    if not system.exists(_path(spark, folder)):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(_path(spark, folder)))


def _newest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the last published version; 0 and None if there is none."""
    numbers = [int(entry) for entry in _entries(spark, f"{path}/versions") if entry.isdigit()]
    if not numbers:
        return 0, None
    stream = _system(spark, path).open(_path(spark, f"{path}/versions/{max(numbers):012d}"))
    try:
        return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Publish a version; False if another writer has taken the number in the meantime."""
    aside = _path(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    stream = _system(spark, path).create(aside, False)
    stream.write(json.dumps(content).encode())
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    # without the option to overwrite, renaming fails if the number is taken
    kinds = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(aside), context.makeQualified(_path(spark, f"{path}/versions/{number:012d}")), kinds)
        return True
    except Exception as error:
        _system(spark, path).delete(aside, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise
