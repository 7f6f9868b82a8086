"""The folder that a cluster shares, tables written there, and files of the usual kinds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False, lenient: bool = False) -> DataFrame:
    """JSON documents of a known schema, one per file or per line; lenient leaves out what cannot be read."""
    mode = "DROPMALFORMED" if lenient else "FAILFAST"
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", mode).option("encoding", "UTF-8").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, text without a byte-order mark."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", F.regexp_replace("value", "^﻿", "").alias("text"))


def read_files(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """Files as they are: path, length, modificationTime, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", deep).load(path)


def fingerprints(files: DataFrame, most: int = 8 << 20, part: int = 4 << 20) -> DataFrame:
    """path, size, sha256 of the content, or of its first and last `part` bytes if it is longer than `most`."""
    ends = F.concat(F.substring("content", 1, part), F.expr(f"substring(content, -{part}, {part})"))
    return files.select("path", F.col("length").alias("size"), F.sha2(F.when(F.col("length") <= most, F.col("content")).otherwise(ends), 256).alias("sha256"))


def pcm_samples(files: DataFrame, channels_offset: int = 44) -> DataFrame:
    """16-bit mono samples of WAV files with a plain header: path, n, x. Decoded in batches of bytes on the executors."""
    import numpy as np
    import pyarrow as pa

    def decode(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                samples = np.frombuffer(content[channels_offset : len(content) - (len(content) - channels_offset) % 2], "<i2")
                for at in range(0, len(samples), 100_000):
                    part = samples[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part.astype(np.int32))], ["path", "n", "x"])

    return files.select("path", "content").mapInArrow(decode, "path string, n long, x int")


def publish(df: DataFrame, folder: str, version: int) -> str:
    """Write one version once: fails if it is there already."""
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def append_log(df: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    df.write.mode("append").json(path)


def next_version(spark: SparkSession, folder: str) -> int:
    """One more than the last version that is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 1
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=") and n[8:].isdigit()), default=0) + 1


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """A published version."""
    return spark.read.parquet(f"{folder}/version={version}")


def read_replaced(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that replace_with wrote last; None before the first time."""
    last = next_version(spark, folder) - 1
    return read_version(spark, folder, last) if last else None


def replace_with(spark: SparkSession, folder: str, change) -> None:
    """Write change(old table or None) beside the old one and then give it its name at once, so that readers see one or the other whole."""
    new = next_version(spark, folder)
    staged = f"{folder}/staged-{uuid.uuid4().hex}"
    change(read_replaced(spark, folder)).write.parquet(staged)
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(staged)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(path, jvm.Path(f"{folder}/version={new}")):
        raise FileExistsError(f"{folder}/version={new} was written by another")


def publish_texts(texts: DataFrame, folder: str, version: int) -> str:
    """Write texts (a column) once as files of one version, with plain line ends: fails if it is there already."""
    path = f"{folder}/version={version}"
    texts.write.mode("errorifexists").option("lineSep", "\n").text(path)
    return path


LEVELS_A_ROW = 4096


def pack_levels(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Level series as rows of raw 32-bit floats: keys, part, first (its first index), data."""
    import numpy as np
    import pyarrow as pa

    part = F.floor(F.col("i") / LEVELS_A_ROW).cast("long").alias("part")
    rows = levels.groupBy(*keys, part).agg(F.min("i").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("db").cast("float").alias("db")))), lambda x: x["db"]).alias("db"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def pack(batches):
        for batch in batches:
            data = pa.array([np.asarray(x, "<f4").tobytes() for x in batch.column("db").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], data], [*batch.schema.names[:-1], "data"])

    return rows.mapInArrow(pack, f"{kinds}, part long, first long, data binary")


def unpack_levels(packed: DataFrame, keys: list[str]) -> DataFrame:
    """The series that pack_levels packed: keys, i, db."""
    import numpy as np
    import pyarrow as pa

    kinds = ", ".join(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys)

    def unpack(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                db = np.frombuffer(batch.column("data")[at].as_py(), "<f4")
                i = np.arange(len(db)) + batch.column("first")[at].as_py()
                same = [pa.array([batch.column(k)[at].as_py()] * len(db), batch.schema.field(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*same, pa.array(i), pa.array(db)], [*keys, "i", "db"])

    return packed.select(*keys, "first", "data").mapInArrow(unpack, f"{kinds}, i long, db float")
