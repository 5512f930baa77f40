"""Tables kept in the folder that driver and executors share, and found again by what they were made from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_found: dict[tuple[str, str, str], object] = {}
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; where it is unset a temporary folder if all runs in one process, else None."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        return None
    return _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-tables-"))


def signature(df: DataFrame) -> str:
    """A digest of the files that df is read from: paths, sizes and times of change. Reads no column."""
    m = df.select(F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct()
    return m.agg(F.md5(F.to_json(F.array_sort(F.collect_list("f")))).alias("s")).first().s


def once(source: DataFrame, kind: str, make: Callable[[str], object]) -> object:
    """What make(folder) returns, made once in an application for each state of the files that `source` is read from; folder is new, in the shared folder."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, kind, signature(source))
    if key not in _found:
        _found[key] = make(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    return _found[key]


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder, in place of what has the new name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(new), True)
    if not fs.rename(path(old), path(new)):
        raise OSError(f"{old} can't be renamed to {new}")
