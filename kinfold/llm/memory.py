"""Memory of the driver and of reused Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def trim_jvm(spark: SparkSession) -> str:
    """Free native memory of the driver's JVM goes back to the system, as give_back() does for Python: what compilers, codecs and ended threads have freed
    stays in glibc's arenas otherwise. Returns what the JVM says; nothing where it has no such command (before 17.0.9, other systems)."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    types = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        kinds, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        given = (jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0))
        for k, (kind, value) in enumerate(zip(types, given)):
            kinds[k], args[k] = jvm.java.lang.Class.forName(kind), value
        call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        return str(call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    except Py4JError:
        return ""


def driver_gives_back(spark: SparkSession) -> None:
    """Garbage of ended queries goes, and with it their shuffle files; the driver's heap shrinks to what it needs, and so does its native memory."""
    gc.collect()
    give_back()
    spark._jvm.java.lang.System.gc()
    trim_jvm(spark)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of Arrow batches; at a partition's end the worker gives free memory back to the system, since a later stage has the same worker."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole
