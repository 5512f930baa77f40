"""Helpers that the operators of this subpackage share: tables, checkpoints and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.ship import ship

#: Bytes of text that one step of an Arrow mapper holds at once (a longer single text is a step of its own).
CHUNK_BYTES = 1_000_000
#: Rows of an Arrow batch between JVM and Python: texts are long, and both sides hold a batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all runs in one process (tests), a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarry-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands Python workers BATCH_ROWS rows at a time at most, and has shipped the package to them."""
    ship(df.sparkSession)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; survives the loss of executors."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    trim(df.sparkSession)
    return out


def forget(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to any more: the shuffle files and checkpoints of stages before a cut."""
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Return the driver's freed native memory to the system: compiling the code of many plans leaves hundreds of MB in the allocator. Where a JVM has no such command nothing is done."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, said = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    try:
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(kind)
        said[0], said[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's class isn't public; its interface is.
        jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), said)
    except Py4JError:
        pass


def _give_back() -> None:
    """Return the memory that a task has freed to the system: a Python worker outlives its task, and idles beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def columns(df: DataFrame) -> dict:
    """A small result's columns as numpy arrays, by Arrow."""
    got = df.toArrow()
    return {n: got[n].to_numpy() for n in got.column_names}


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that their texts hold about `limit` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        yield from _pieces(batch, column, limit)
    _give_back()


def _pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def blobs(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes, a null as an empty text."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def held_out(doc_id, remainder: int):
    """True where crc32 of doc_id as text leaves `remainder` modulo 5 (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == remainder
