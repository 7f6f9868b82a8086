"""Shared folder, written tables and Arrow plumbing of the operators here."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = "1000", str(16 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir; where that is unset, one of this machine if all of Spark runs here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders made by the run at hand and not deleted yet; outside of runs those of all.
_made: ContextVar[list[str]] = ContextVar("made", default=[])  # noqa: B039


@contextlib.contextmanager
def tables_of_a_run(spark: SparkSession) -> Iterator[None]:
    """Folders made within belong to this run alone; if it fails, all of them are deleted."""
    mine = _made.set([])
    try:
        yield
    except BaseException:
        release(spark, [])
        raise
    finally:
        _made.reset(mine)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, which release() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.get().append(path)
    return path


def made() -> list[str]:
    return list(_made.get())


#: Of the driver's largest heap, from which on its garbage is collected between jobs, so that the heap shrinks again.
HEAP_SHARE = 0.6


def give_back(spark: SparkSession, collect: bool = False) -> None:
    """Return to the machine what the driver has freed: of the heap if it grew large or `collect` is set, and of native memory.

    Planning, compiling and packing take native memory in many threads, and the allocator keeps what they free; after many small jobs
    that is hundreds of MB. Collecting also lets Spark delete the shuffle files of plans that nothing refers to.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    heap = jvm.Runtime.getRuntime()
    if collect or heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()
        jvm.System.gc()

    def array(kind, *items):
        out = new(kind, len(items))
        for i, item in enumerate(items):
            out[i] = item
        return out

    named, command = jvm.Class.forName, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    kinds = [named(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, *kinds))  # the server's own class is not public
    given = array(jvm.Object, command, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String))
    with contextlib.suppress(Py4JJavaError):  # a JVM without that command
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Writer options of tables whose values are compressed already and large.
PACKED = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**(options or {})).parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: list[str]) -> None:
    """Delete the folders made so far but for those to keep; what was derived from them must have been written by then."""
    for folder in [x for x in _made.get() if x not in keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.get().remove(folder)


def sized(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df in no more partitions than `rows` (a bound of its rows) call for, so that small tables do not become many small files."""
    n = 1 + rows // each
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of one Arrow batch, since single texts may be long. The setting stays, as results are computed later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fold(column: str, buckets: int):
    """crc32 of the id as text, modulo buckets; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % F.lit(buckets)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken, wanted: str) -> str:
    """wanted, with underscores added until no column of that name (in any case) exists."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted
