"""What the operators share: shared-storage folders, shipping of code, sizing of partitions, lean workers."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than the ASCII white space 09-0D and 20; ``bytes.split()`` cuts at just these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Make this package usable on executors and keep Arrow batches small enough for very long texts.

    Where the executors' ``PYTHONPATH`` does not hold the repository, functions are pickled with their code.
    Frames run after the operator has returned them, so the session's batch limits stay lowered.
    """
    import rundelta

    root = str(Path(rundelta.__file__).resolve().parent.parent)
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        cloudpickle.register_pickle_by_value(rundelta)
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 * 1024 * 1024)):
        if int(spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")) > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return spark


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared folder that the session names in ``spark.checkpoint.dir``.

    Where that setting is absent, a local temporary folder takes its place in local mode (tests) only;
    on a cluster its absence is an error, as executors do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="rundelta-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rundelta/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame as Parquet on shared storage and read it back: lineage ends, lost executors cost nothing.

    ``discard`` removes the files of such a frame when nothing reads it any more.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``materialize`` returned; no frame may read them later."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Return what the allocators of this process keep to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Let the driver drop what earlier plans hold: Python's references first, then the JVM's objects behind them."""
    gc.collect()
    give_back()
    spark._jvm.java.lang.System.gc()


def lean(run, *caches):
    """A task function after which the worker, which later tasks use again, holds no more than before it.

    ``caches`` are emptied, and memory that the allocators keep goes back to the system.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            give_back()

    return task


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a Hadoop-style URI and the path in it."""
    for hadoop in ("s3a://", "s3n://"):
        if uri.startswith(hadoop):
            uri = "s3://" + uri.removeprefix(hadoop)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, chunks) -> int:
    """Write byte chunks under a name of this attempt only, then move the whole file into place."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    total = 0
    with fs.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
            total += len(chunk)
    fs.move(temporary, path)
    return total


def read_range(handle, offset: int, length: int) -> bytes:
    """Bytes of a random-access file; a short read is an error."""
    data = handle.read_at(length, offset)
    if len(data) != length:
        raise ValueError(f"truncated file: wanted {length} bytes at {offset}, found {len(data)}")
    return data


#: A larger estimate stands for "unknown": Catalyst gives frames without statistics the largest long.
PLAUSIBLE_BYTES = 1 << 60


def partitions_for(df: DataFrame) -> int:
    """Partitions of about ``spark.sql.files.maxPartitionBytes`` each, at least the session's shuffle partitions.

    The size is that of the tables under the frame by Catalyst's statistics, so no job runs.  Tables
    without statistics (rows of the driver, RDDs) count nothing: they get the shuffle partitions.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    each = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(sum(s for s in sizes if s < PLAUSIBLE_BYTES) / each))


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their plain names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def filtered(docs: DataFrame, run) -> DataFrame:
    """Rows of all columns that ``run`` leaves of their Arrow batches, whatever the columns are called."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


def bucket_of(column: str, n: int, salt: int = 0):
    """``crc32(text of the column) mod n``: the fold rule of the contracts."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))
