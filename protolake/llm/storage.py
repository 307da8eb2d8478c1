"""Shared folders: scratch tables and raw files that every executor can reach.

The cluster names the folder in spark.checkpoint.dir. Only a local master may
leave that unset (tests): then a temporary folder of this machine is used; a
cluster without it is refused, as its tasks would write to their own disks. Raw
files are written under names that no other attempt uses, and only files that a
finished task has listed are read, so lost executors leave garbage at most.
Folders under a named directory stay until discard_scratch() or the cluster's
own cleaning, since results are read from them lazily.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from protolake.llm.kernels import give_back

_own: list[str] = []
_made: list[str] = []
_next_rest = 0.0


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="protolake-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNSET = "67108864b"  # Spark's own value


def small_batches(df: DataFrame, most: str = "4m") -> DataFrame:
    """df, after setting the bytes that a batch of rows for Python may hold in this session, unless the session has a bound of its own: Spark's is 64 MB, for each task and in both processes."""
    if df.sparkSession.conf.get(_BATCH) == _UNSET:
        df.sparkSession.conf.set(_BATCH, most)
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard_scratch(spark: SparkSession) -> None:
    """Delete all scratch folders of this driver. DataFrames that still read them fail afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def rest(spark: SparkSession, pause: float = 5.0) -> None:
    """Free memory of the driver's JVM and Python goes back to the system: else the JVM stays as large as the plans of all jobs so far have made it.

    A rest collects the JVM's garbage, so the next one comes after ``pause`` seconds, or 20 times as long as this one took.
    """
    global _next_rest
    began = time.monotonic()
    if began < _next_rest:
        return
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    with suppress(Py4JError, StopIteration):  # a JVM without this command keeps what its allocator holds
        server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")  # of the interface: its class is not open to callers
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    give_back()
    _next_rest = time.monotonic() + max(pause, 20 * (time.monotonic() - began))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage, computes once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    rest(spark)
    return spark.read.schema(df.schema).parquet(path)


def _located(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def open_to_write(uri: str):
    """A binary output stream in a folder that is made if missing; works in tasks."""
    fs, path = _located(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def open_to_read(uri: str):
    """A random-access binary file; works in tasks."""
    fs, path = _located(uri)
    return fs.open_input_file(path)
