"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from py4j.java_gateway import JavaClass, JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that is unset, a session on this machine alone takes the temporary folder; a cluster has
    no folder that all executors see, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/lakecover-checkpoints"
    return f"{base.rstrip('/')}/lakecover/{uuid.uuid4().hex}"


_passing: dict[int, list[list[str]]] = {}  # by thread, the folders that each open ``passing`` is to delete


def written(df: DataFrame, **options: object) -> DataFrame:
    """``df`` written, with the writer's options if any, and read again: short lineage that outlives lost executors."""
    folder = shared_folder(df.sparkSession)
    if open_ := _passing.get(threading.get_ident()):
        open_[-1].append(folder)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What this thread writes inside is deleted at the end, and shuffle files with it; but for tables passed to the function that it gives, which are written for good."""
    made: list[str] = []
    open_ = _passing.setdefault(threading.get_ident(), [])
    open_.append(made)

    def keep(df: DataFrame) -> DataFrame:
        open_.pop()
        try:
            return written(df)
        finally:
            open_.append(made)

    try:
        yield keep
    finally:
        open_.pop()
        for folder in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        let_go(spark)


def give_back(spark: SparkSession) -> None:
    """Have the driver's JVM return the native memory that it has freed; a JVM without that command keeps it.

    Planning and compiling allocate outside the heap, in many threads, and the allocator keeps what they free: over a run of large plans some hundred MB.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind: JavaClass, *of: object) -> JavaObject:
        out = gateway.new_array(kind, len(of))
        for i, x in enumerate(of):
            out[i] = x
        return out

    named, nothing, no_kinds = jvm.java.lang.Class.forName, array(jvm.java.lang.Object), array(jvm.java.lang.String)
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    kinds = array(jvm.java.lang.Class, commands.getClass(), named("java.lang.String"), nothing.getClass(), no_kinds.getClass())
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    with suppress(Py4JJavaError):
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", nothing, no_kinds))


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark then deletes on all executors the shuffle files of steps whose results are written and that no plan refers to any more."""
    spark.sparkContext._jvm.System.gc()
